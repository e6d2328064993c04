"""Cutting lineage, and writes as plans: upserts, deletes, snapshots."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EDGE_KEY, Graph, valid_nodes

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and the
    master is this machine (tests)."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _own = _own or tempfile.mkdtemp(prefix="loomgraph-")
    return _own


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows that are sent to every executor, sooner than that a large table is shuffled to meet them.
FEW = 200_000


def sent(df: DataFrame, n: int) -> DataFrame:
    """``df``, of ``n`` rows, as a side of a join: broadcast if these are few."""
    return F.broadcast(df) if n <= FEW else df


_stored: weakref.WeakSet = weakref.WeakSet()


def stored(df: DataFrame, *columns: str) -> DataFrame:
    """Like :func:`cut`, for large tables that are read many times: kept as Parquet, so
    they are compressed and readers take the columns and row groups that they need.
    What is stored already is not stored again. The files go when the process ends."""
    if any(df is s for s in _stored):
        return df.select(*columns) if columns else df
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df = df.select(*columns) if columns else df
    df.write.parquet(at)
    atexit.register(_forget, spark, at)
    out = spark.read.schema(df.schema).parquet(at)
    _stored.add(out)
    return out


def _forget(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended: its folder is its own
        pass


def newest(df: DataFrame, keys: Iterable[str], order: str) -> DataFrame:
    """One row of each key: that of the greatest ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", order)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; of equal keys in
    ``new`` the last by the order of its columns wins."""
    tagged = new.withColumn("_w", F.struct(*[c for c in new.columns if not c.startswith("_") and dict(new.dtypes)[c][:3] != "map"]))
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns).unionByName(newest(tagged, keys, "_w"))


def insert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(nodes, valid_nodes(new), "id")


def identity(df: DataFrame) -> DataFrame:
    """First row of each edge identity; a null line or column is -1."""
    keys = ["source", "target", "kind", F.coalesce("line", F.lit(-1)), F.coalesce("col", F.lit(-1))]
    named = df.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys[3:])))
    return named.dropDuplicates(["source", "target", "kind", "_k0", "_k1"]).drop("_k0", "_k1")


def insert_edges(g: Graph, new: DataFrame) -> DataFrame:
    """The graph's edges with ``new`` ones whose ends both exist, each once."""
    ids = g.nodes.select("id")
    kept = new.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return identity(g.edges.unionByName(kept.select(*g.edges.columns)))


def absent(new: DataFrame, old: DataFrame, *on: str) -> DataFrame:
    """Rows of ``new`` whose columns ``on`` (nulls are equal) no row of ``old`` has; of
    ``old``, which may be large, only rows that share the first of them are compared."""
    new = stored(new)
    n = new.count()
    if not n:
        return new
    marked = lambda df: df.withColumns({f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(on)})
    if n <= FEW:
        old = old.join(F.broadcast(new.select(on[0]).distinct()), on[0], "left_semi")
    keys = [f"_k{i}" for i in range(len(on))]
    return stored(marked(new).join(marked(old.select(*on)).select(*keys), keys, "left_anti").select(*new.columns))


def add_edges(g: Graph, new: DataFrame) -> DataFrame:
    """As :func:`insert_edges` where the graph's edges hold each identity once: these
    are not sorted out again, only what is new is."""
    ids = g.nodes.select("id")
    kept = new.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return g.edges.unionByName(absent(identity(kept.select(*g.edges.columns)), g.edges, *EDGE_KEY))


def without(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def delete_files(g: Graph, paths: DataFrame) -> Graph:
    """Without the files, their nodes, and what hangs on these."""
    gone = g.nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    return Graph(
        without(g.nodes, gone, "id"),
        without(without(g.edges, gone.withColumnRenamed("id", "source"), "source"), gone.withColumnRenamed("id", "target"), "target"),
        without(g.files, paths, "path") if g.files is not None else None,
        without(g.refs, gone.withColumnRenamed("id", "from_node_id"), "from_node_id") if g.refs is not None else None,
    )


def delete_nodes(g: Graph, ids: DataFrame) -> Graph:
    gone = ids.select("id")
    edges = without(without(g.edges, gone.withColumnRenamed("id", "source"), "source"), gone.withColumnRenamed("id", "target"), "target")
    refs = without(g.refs, gone.withColumnRenamed("id", "from_node_id"), "from_node_id") if g.refs is not None else None
    return Graph(without(g.nodes, gone, "id"), edges, g.files, refs)


def delete_edges_from(g: Graph, ids: DataFrame) -> Graph:
    return g.with_edges(without(g.edges, ids.select(F.col("id").alias("source")), "source"))


def insert_refs(refs: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with ``new`` references as pending ones; a row that is there already
    is not put in again."""
    keys = ["from_node_id", "reference_name", "reference_kind", "line", "col"]
    held = refs.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys)).distinct()
    tagged = new.select("*", *(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys))
    fresh = tagged.join(held, [f"_{k}" for k in keys], "left_anti").dropDuplicates([f"_{k}" for k in keys])
    return refs.unionByName(fresh.select(*refs.columns).withColumn("status", F.lit("pending")))


def delete_refs(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """By whatever columns ``keys`` has: ids, nodes, or (node, name, kind)."""
    return without(refs, keys, *keys.columns)


def metadata_set(metadata: DataFrame, key: str, value: str) -> DataFrame:
    return upsert(metadata, metadata.sparkSession.createDataFrame([(key, value)], "key string, value string"), "key")


def metadata_get(metadata: DataFrame, key: str) -> str | None:
    row = metadata.filter(F.col("key") == key).first()
    return row["value"] if row else None


def save(g: Graph, root: str) -> str:
    """Write a snapshot of all tables into a new folder of ``root`` and give its
    name. Readers go on with the snapshot that they have."""
    at = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    for name in ("nodes", "edges", "files", "refs"):
        df = getattr(g, name)
        if df is not None:
            df.write.parquet(f"{at}/{name}")
    return at


def load(spark: SparkSession, at: str, parts: Iterable[str] = ("nodes", "edges", "files", "refs")) -> Graph:
    return Graph(**{name: spark.read.parquet(f"{at}/{name}") for name in parts})


def bucketed(edges: DataFrame, name: str, buckets: int) -> None:
    """Two tables of edges, bucketed by source and by target, for joins without
    a shuffle where the same edges are joined again and again."""
    for side in ("source", "target"):
        edges.write.bucketBy(buckets, side).sortBy(side, "kind").mode("overwrite").saveAsTable(f"{name}_by_{side}")
