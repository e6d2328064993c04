"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of one Arrow batch that crosses into Python. Very long texts then come
#: a few at a time, whatever the number of rows in a batch would be.
BATCH_BYTES = 2 << 20
#: Characters that a worker handles at once with vector operations.
BLOCK_CHARS = 1 << 21

_own_root: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and the
    master is this machine (tests)."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="loomgraph-")
    return _own_root


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike :func:`cut` the result has a known size, so that Spark itself can
    decide whether a join may broadcast it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    """Delete a stashed table when the program ends, if its session is still there."""
    with contextlib.suppress(Exception):
        sc = spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession, rows: int = 4096) -> None:
    """Bound the Arrow batches of this session by bytes as well as by rows, and
    let Python workers of this machine find the package (on a cluster it is sent
    with ``--py-files`` or installed)."""
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), home]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` begins with it."""
    low = [c.lower() for c in df.columns]
    while any(c.startswith(name) for c in low):
        name += "_"
    return name


def ddl(schema: StructType, more: str) -> StructType:
    """``schema`` with the columns of the DDL string ``more``; all may be null."""
    out = StructType([f for f in schema.fields])
    for f in StructType.fromDDL(more).fields:
        out = out.add(f)
    return out


def give_back() -> None:
    """Return memory that this worker has freed to the system, where that can be
    asked for: workers are reused, and the next stage may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


Batches = Iterator[pa.RecordBatch]
#: What a worker keeps from task to task, by the module that keeps it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(module: str, forget: Callable[[], None]) -> None:
    """Say how to forget what ``module`` keeps in a worker from task to task."""
    _kept[module] = forget


def begin(module: str) -> None:
    """A worker that served another operator before forgets what that one kept."""
    for other, forget in _kept.items():
        if other != module:
            forget()
    give_back()


def lean(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``f`` over a partition's batches, with the memory of other operators and of
    earlier tasks given back first."""
    module = f.__module__

    def run(batches: Batches) -> Batches:
        begin(module)
        yield from f(batches)
        give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language(lang: Column) -> Column:
    """A language code of two or three letters, else ``und``.

    There are at most 26**2 + 26**3 + 1 = 18253 values, which bounds every
    per-language table that is sent to the executors.
    """
    low = F.lower(lang)
    return F.when(low.rlike("^[a-z]{2,3}$"), low).otherwise(F.lit("und"))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def blocks(lengths: list[int], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to about ``limit``; one row at least."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
