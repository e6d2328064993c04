"""Sharding by balanced label propagation, with shards of equal row counts.

Linked documents share a hub; by default the hub of a document is its text, so
equal texts are linked. Links between hubs can be given besides. Documents without
a link can go anywhere: they are dealt out last and fill every shard to its quota,
which makes the counts differ by one at most (the law ``rows``).

Linked documents are first dealt out evenly. The documents that a hub has in one
shard form bundles, a bounded number for each shard, whatever its number of
documents; none is more than a 64th of a shard. Then, round by round, each bundle
asks to move to the shard that holds most of its own hub and of those linked to it.
Requests from shard a to shard b are granted as far as b has room, or as the
requests from b to a make room; they are counted in hashed cells, so the driver
sees a bounded table (shards squared times :data:`CELLS`), never bundles. Rounds end
when nothing more is granted or no round has lessened the cut links for
:data:`PATIENCE` rounds; the best round counts. A hub larger than a shard stays
split. :func:`cut_links` tells what is still cut.

Defined cases: a null text is as an empty one. Null doc_ids are rows like others.
Repeated rows are linked, and each has a slot. Very long texts take part by their
hash and size only. Ties between shards are broken by a hash of hub and shard. Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS, ROUNDS, PATIENCE = 16, 40, 2
#: Cells in which the requests between two shards are counted.
CELLS = 64
#: Bits of the rows of a run that are numbered together, of the runs of a block, and
#: of the blocks of a page.
RUN = 12


def numbered(df: DataFrame, within: list[str], row: str, name: str) -> DataFrame:
    """``df`` with ``name``: gapless numbers from 0 among equal ``within``.

    ``row`` is a unique number; rows whose numbers agree but for the last
    :data:`RUN` bits are numbered together. Where runs begin follows from sums over
    blocks of 2**RUN runs and pages of 2**RUN blocks, so no task gets more than that
    many runs or blocks; pages are one for each eight partitions of the table.
    """
    run = df.withColumn("_run", F.shiftright(row, RUN))
    sizes = run.groupBy(*within, "_run").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.shiftright("_run", RUN))
    sizes = common.cut(sizes.withColumn("_page", F.shiftright("_block", RUN)))

    def begins(of: DataFrame, group: list[str], order: str, out: str) -> DataFrame:
        w = Window.partitionBy(*within, *group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return of.withColumn(out, F.coalesce(F.sum("_n").over(w), F.lit(0)))

    blocks = begins(sizes.groupBy(*within, "_page", "_block").agg(F.sum("_n").alias("_n")), ["_page"], "_block", "_of_block").drop("_n", "_page")
    pages = begins(sizes.groupBy(*within, "_page").agg(F.sum("_n").alias("_n")), [], "_page", "_of_page").drop("_n")
    runs = begins(sizes, ["_block"], "_run", "_of_run").drop("_n").join(blocks, [*within, "_block"]).join(pages, [*within, "_page"])
    runs = runs.select(*within, "_run", (F.col("_of_run") + F.col("_of_block") + F.col("_of_page")).alias("_begin"))
    at = F.row_number().over(Window.partitionBy(*within, "_run").orderBy(row))
    return run.join(runs, [*within, "_run"]).withColumn(name, F.col("_begin") + at - 1).drop("_run", "_begin")


def quotas(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def grants(wanted: np.ndarray, load: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """The number of cells granted for each (from, to): wanted[a, b, cell] is the
    weight that asks to move from a to b. No shard gets over its quota."""
    shards = len(load)
    sums = np.concatenate([np.zeros((shards, shards, 1), np.int64), wanted.cumsum(2)], axis=2)
    asked = sums[:, :, -1]
    free = np.maximum(quota - load, 0)
    share = free[None, :] * asked // np.maximum(asked.sum(0), 1)[None, :]
    allowed = np.minimum(asked, np.minimum(asked, asked.T) + share)
    granted = np.zeros((shards, shards), np.int64)
    for a in range(shards):
        for b in range(shards):
            granted[a, b] = np.searchsorted(sums[a, b], allowed[a, b], "right") - 1
    pick = np.indices((shards, shards))
    while True:
        moved = sums[pick[0], pick[1], granted]
        after = load + moved.sum(0) - moved.sum(1)
        over = np.flatnonzero((after > quota) & (moved.sum(0) > 0))
        if not len(over):
            return granted
        for b in over:  # give back the last cell of the largest flow
            a = int(moved[:, b].argmax())
            granted[a, b] = np.searchsorted(sums[a, b], sums[a, b, granted[a, b]], "left") - 1


def propagate(bundles: DataFrame, quota: np.ndarray, rounds: int = ROUNDS, links: DataFrame | None = None) -> DataFrame:
    """Move bundles (hub, origin, part, n, shard) towards the shard of most of their
    hub and, by (a, b) of ``links``, of the hubs linked to it."""
    shards, spark = len(quota), bundles.sparkSession
    state = common.cut(bundles)
    if links is not None:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
        links = common.cut(both)
    best, least, since = state, None, 0
    for turn in range(rounds):
        load = np.zeros(shards, np.int64)
        for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            load[r["shard"]] = r["n"]
        there = state.groupBy("hub", "shard").agg(F.sum("n").alias("n"))
        if links is not None:
            near = there.join(links, there["hub"] == links["b"]).select(F.col("a").alias("hub"), "shard", "n")
            there = there.unionByName(near).groupBy("hub", "shard").agg(F.sum("n").alias("n"))
        goal = there.groupBy("hub").agg(F.max_by("shard", F.struct("n", F.xxhash64("hub", "shard"))).alias("goal"), (F.sum("n") - F.max("n")).alias("away"))
        cell = F.pmod(F.xxhash64("hub", "origin", "part", F.lit(turn)), F.lit(CELLS)).cast("int")
        asks = common.cut(state.join(goal, "hub").withColumn("cell", F.when(F.col("goal") != F.col("shard"), cell)))
        cut = asks.filter("cell is not null").agg(F.sum("n")).first()[0] or 0
        if least is None or cut < least:
            best, least, since = state, cut, 0
        else:
            since += 1
        if not cut or since > PATIENCE:
            break
        wanted = np.zeros((shards, shards, CELLS), np.int64)
        for r in asks.filter("cell is not null").groupBy("shard", "goal", "cell").agg(F.sum("n").alias("n")).collect():
            wanted[r["shard"], r["goal"], r["cell"]] = r["n"]
        granted = grants(wanted, load, quota)
        if not granted.any():
            break
        allowed = spark.createDataFrame([(a, b, int(granted[a, b])) for a in range(shards) for b in range(shards)], "shard int, goal int, cells int")
        moved = asks.join(F.broadcast(allowed), ["shard", "goal"], "left")  # shards squared rows
        goes = F.col("cell").isNotNull() & (F.col("cell") < F.col("cells"))
        state = common.cut(moved.select("hub", "origin", "part", "n", F.when(goes, F.col("goal")).otherwise(F.col("shard")).alias("shard")))
    return best


def text_hub() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def assign(docs: DataFrame, shards: int = SHARDS, hub: Column | None = None, rounds: int = ROUNDS, links: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) by document. ``links`` (a, b) are pairs
    of values of ``hub``; with the doc_id as hub they are links between documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (text_hub() if hub is None else hub).alias("hub"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = common.cut(rows)  # from here on the rows' numbers are fixed
    total = rows.count()
    quota = quotas(total, shards)
    hubs = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    met = F.col("members") > 1
    if links is not None:
        ends = links.select(F.col("a").alias("hub")).unionByName(links.select(F.col("b").alias("hub"))).distinct().withColumn("linked", F.lit(True))
        hubs, met = hubs.join(ends, "hub", "left"), met | F.coalesce("linked", F.lit(False))
    known = common.cut(rows.join(hubs.withColumn("met", met).drop("linked"), "hub", "left").fillna(False, ["met"]))
    single = known.filter("not met").drop("members", "hub", "met")
    parts = F.ceil(F.col("members") / (shards * max(1, int(quota[-1]) // 64)))
    linked = numbered(known.filter("met").drop("met"), [], "row", "rank").withColumn("origin", (F.col("rank") % shards).cast("int"))
    linked = common.cut(linked.withColumn("part", F.pmod(F.floor(F.col("rank") / shards), parts).cast("int")).drop("rank", "members"))
    bundles = linked.groupBy("hub", "origin", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", F.col("origin"))
    placed = propagate(bundles, quota, rounds, links)
    load = np.zeros(shards, np.int64)
    for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[r["shard"]] = r["n"]
    joined = linked.join(placed.select("hub", "origin", "part", "shard"), ["hub", "origin", "part"]).drop("hub", "origin", "part")
    ends = np.cumsum(quota - load)
    shard = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        shard = F.when(F.col("rank") < int(ends[s]), F.lit(s)).otherwise(shard)
    filled = numbered(single, [], "row", "rank").withColumn("shard", shard.cast("int")).drop("rank")
    both = common.cut(joined.select(*filled.columns).unionByName(filled))
    return numbered(both, ["shard"], "row", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def cut_links(assigned: DataFrame, key: list[str]) -> DataFrame:
    """One row: documents that are not in the shard with most of their group."""
    there = assigned.groupBy(*key, "shard").agg(F.count(F.lit(1)).alias("n"))
    return there.groupBy(*key).agg((F.sum("n") - F.max("n")).alias("away"), F.sum("n").alias("n")).filter("n > 1").agg(F.sum("away").alias("cut"), F.sum("n").alias("linked"))
