"""Nearest neighbours by a permutation index.

A vector is represented by its ``PREFIX`` nearest pivots, nearest first. The index
is a table of segments of at most ``SEGMENT`` rows, spread by hash; each has
pivot inverted files, which list for each pivot the segment's rows that have it
in their prefix, with its place there. For a query the files of its own
``PREFIX`` pivots are read and what each adds to the footrule distance is summed
by row; a pivot that one of the two orders lacks counts as if it came just after
the prefix. The rows of least footrule are ranked again by exact Euclidean
distance: ``WIDE`` times the square root of the number of rows, over all segments.

A query so reads PREFIX**2 / PIVOTS (18) places for each row and the vectors of a
number of rows that falls, as a share, with the size of the table. Pivots are a
bounded sample: the ``PIVOTS`` vectors of least hash. Every row is indexed. The
query set meets the index in blocks of ``BLOCK``: each lane of segments gets the
blocks once, and the segments themselves are never copied.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another than the most frequent length
(the smaller, in a tie). Rows with the query's vec_id are its own. Of repeated
query ids one is kept. Ties of distance go to the smaller vec_id, ties of
footrule are all ranked again, so copies of a vector are found together. Very
long vectors make segments of fewer rows (``SEGMENT_BYTES``). Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PIVOTS, PREFIX, WIDE, NEAREST = 512, 96, 11.0, 10
#: Rows of a segment and their bytes, queries of a block.
SEGMENT, SEGMENT_BYTES, BLOCK = 16384, 1 << 24, 1024
_INDEX = "lane int, segment long, ids binary, vectors binary, starts binary, rows binary, places binary"
_FOUND = "query_id long, vec_id long, score double"


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, as doubles."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(e, lambda x: x != 0)
    fit = rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return fit.filter(F.coalesce(F.forall("embedding", lambda x: x.isNotNull()), F.lit(False))).filter(finite & some)


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, in order; ties go to the first."""
    out = np.empty((len(x), prefix), np.int32)
    length = (pivots * pivots).sum(1)
    for a in range(0, len(x), 2048):
        d = length[None, :] - 2 * x[a : a + 2048] @ pivots.T
        out[a : a + 2048] = d.argsort(axis=1, kind="stable")[:, :prefix]
    return out


def inverted(order: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted files, one after the other: where each pivot's begins, the rows that
    have the pivot in their prefix, and its places there."""
    rows, prefix = order.shape
    by = np.argsort(order.ravel(), kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(order.ravel(), minlength=pivots))])
    return starts.astype(np.int32), (by // prefix).astype(np.int32), (by % prefix).astype(np.int16)


def gains(query: np.ndarray, starts: np.ndarray, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """By how much the footrule distance of each row to a query's prefix is less
    than that of two prefixes without a common pivot, ``PREFIX * (PREFIX + 1)``."""
    prefix, out = len(query), np.zeros(n, np.int32)
    for place, p in enumerate(query.tolist()):
        a, b = starts[p], starts[p + 1]
        # each row is in a file once, so this adds up rightly
        out[rows[a:b]] += 2 * (prefix - np.maximum(places[a:b], place).astype(np.int32))
    return out


def least(gain: np.ndarray, most: int) -> np.ndarray:
    """The rows of greatest gain: ``most`` at least, and all that tie with the last."""
    if most >= len(gain):
        return np.arange(len(gain))
    above = np.cumsum(np.bincount(gain)[::-1])
    level = len(above) - 1 - int(np.searchsorted(above, most))
    return np.flatnonzero(gain >= level)


def exact(query: np.ndarray, query_id: int, vectors: np.ndarray, ids: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_ids, distances) of the ``k`` nearest of the rows ``near``, in blocks."""
    near = near[ids[near] != query_id]
    d = np.empty(len(near))
    for a in range(0, len(near), 8192):
        off = vectors[near[a : a + 8192]] - query
        d[a : a + 8192] = np.sqrt(np.einsum("ij,ij->i", off, off))
    best = np.lexsort((ids[near], d))[:k]
    return ids[near][best], d[best]


def _arrays(batch: pa.RecordBatch, i: int, *kinds) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in kinds]


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of ``size`` rows at a time."""
    held: list[pa.RecordBatch] = []

    def taken(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        return ids, t.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)

    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= size:
            t = pa.Table.from_batches(held)
            yield taken(t.slice(0, size))
            held = t.slice(size).to_batches()
    if sum(b.num_rows for b in held):
        yield taken(pa.Table.from_batches(held))


def build(fit: DataFrame, pivot: np.ndarray, prefix: int, lanes: int) -> DataFrame:
    """The index: a row for each segment, with its vectors and its inverted files."""
    size = max(1, min(SEGMENT, SEGMENT_BYTES // (8 * max(1, pivot.shape[1]))))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, (ids, x) in enumerate(_packed(batches, size)):
            files = inverted(prefixes(x, pivot, prefix), len(pivot))
            cells = [pa.array([v.tobytes()], pa.binary()) for v in (ids, x, *files)]
            yield pa.RecordBatch.from_arrays([pa.array([part % lanes], pa.int32()), pa.array([part << 32 | n]), *cells], names=[c.split()[0] for c in _INDEX.split(", ")])

    return fit.repartition(lanes, "vec_id").mapInArrow(common.lean(made), _INDEX)


def search(rows: DataFrame, queries: DataFrame, k: int = NEAREST, pivots: int = PIVOTS, prefix: int = PREFIX, wide: float = WIDE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each query."""
    spark = rows.sparkSession
    common.bound_batches(spark)
    fit = valid(rows)
    by_length = fit.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").first()
    length, total = (by_length["length"], by_length["n"]) if by_length else (0, 0)
    fit = fit.filter(F.size("embedding") == length)
    asked = valid(queries).filter(F.size("embedding") == length)
    asked = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    chosen = fit.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(pivots).collect()  # a documented, bounded sample
    pivot = np.array([r["embedding"] for r in chosen], np.float64).reshape(len(chosen), length)
    prefix = min(prefix, len(pivot))
    share = min(1.0, wide / max(1.0, total) ** 0.5)
    lanes = max(1, -(-total // SEGMENT))
    index = common.cut(build(fit, pivot, prefix, lanes))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _packed(batches, BLOCK):
            cells = [pa.array([v.tobytes()], pa.binary()) for v in (ids, x, prefixes(x, pivot, prefix))]
            yield pa.RecordBatch.from_arrays(cells, names=["query_ids", "queries", "prefixes"])

    wanted = asked.count()
    blocks = common.cut(asked.repartition(max(1, -(-wanted // BLOCK)), "query_id").mapInArrow(common.lean(blocked), "query_ids binary, queries binary, prefixes binary"))
    blocks = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, starts, at, places, q_ids, q, orders = _arrays(batch, i, (0, np.int64), (1, np.float64), (2, np.int32), (3, np.int32), (4, np.int16), (5, np.int64), (6, np.float64), (7, np.int32))
                x, q, orders = x.reshape(len(ids), length), q.reshape(len(q_ids), length), orders.reshape(len(q_ids), prefix)
                most = 4 * k + int(np.ceil(share * len(ids)))
                got = [exact(one, q_id, x, ids, least(gains(order, starts, at, places, len(ids)), most), k) for q_id, one, order in zip(q_ids.tolist(), q, orders)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, [len(g[0]) for g in got])), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))],
                    names=["query_id", "vec_id", "score"],
                )

    met = index.join(blocks, "lane").select("ids", "vectors", "starts", "rows", "places", "query_ids", "queries", "prefixes").mapInArrow(common.lean(found), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
