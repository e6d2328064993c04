"""Streams of file changes: bursts, pending sets, and syncs by micro-batch.

Events are (path, ts, event). On a stream ``ts`` must be a timestamp with zone;
the watermark of ten minutes is a choice of this library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "10 minutes"
SHORT_GAP_MS, GAP_MS, FLOOR_MS = 300, 2000, 100
SCOPED = 500
BACKOFF_MOST_MS = 30_000


def source(spark: SparkSession, folder: str, schema: str = "path string, ts timestamp, event string") -> DataFrame:
    """Files of JSON events, as they come."""
    return spark.readStream.schema(schema).json(folder)


def gap(pending: Column, configured_ms: int = GAP_MS) -> Column:
    """The quiet time after which a burst ends: short for one or two pending paths."""
    short = max(FLOOR_MS, min(SHORT_GAP_MS, configured_ms))
    return F.when(pending <= 2, F.lit(f"{short} milliseconds")).otherwise(F.lit(f"{configured_ms} milliseconds"))


def bursts(events: DataFrame, quiet: str | Column = f"{GAP_MS} milliseconds", by: tuple[str, ...] = ("path",), watermark: str | None = WATERMARK) -> DataFrame:
    """(by, start, end, events): sessions of events with no longer pause than
    ``quiet``. Works on tables and on streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming and watermark:
        e = e.withWatermark("ts", watermark)
    s = e.groupBy(*by, F.session_window("ts", quiet).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return s.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def pending(events: DataFrame, started: Column | None = None) -> DataFrame:
    """(path, first_seen, last_seen): paths that have changed since a sync began;
    events after its start keep a path pending."""
    p = events.groupBy("path").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return p if started is None else p.filter(F.col("last_seen") > started)


def backoff_ms(base_ms: int, failures: int) -> int:
    return min(base_ms * 2 ** max(0, failures - 1), BACKOFF_MOST_MS)


def reconcile(paths: DataFrame, most: int = SCOPED) -> DataFrame:
    """(mode, paths): ``none``, ``scoped`` for at most ``most`` changed paths, ``full``."""
    n = F.count(F.lit(1))
    return paths.agg(F.when(n == 0, "none").when(n <= most, "scoped").otherwise("full").alias("mode"), n.alias("paths"))


def retry_after(failures: Column, base_ms: int = GAP_MS) -> Column:
    """:func:`backoff_ms` as a column."""
    doubled = F.lit(base_ms) * F.pow(F.lit(2), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(30)))
    return F.least(doubled, F.lit(BACKOFF_MOST_MS)).cast("long")


def latest(events: DataFrame) -> DataFrame:
    """One row of each path of a micro-batch: its last event."""
    return events.groupBy("path").agg(F.max_by("event", F.struct("ts", "event")).alias("event"), F.max("ts").alias("ts"))


def run(events: DataFrame, scoped: Callable[[DataFrame], None], full: Callable[[], None], checkpoint: str, most: int = SCOPED):
    """Start syncs by micro-batch: of the changed paths, or of everything if there
    are more than ``most``. A batch that fails is given again, as streams do."""

    def each(batch: DataFrame, _: int) -> None:
        paths = latest(batch).persist()
        try:
            if paths.limit(most + 1).count() > most:
                full()
            elif not paths.isEmpty():
                scoped(paths)
        finally:
            paths.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending_state(events: DataFrame, timeout_ms: int = GAP_MS) -> DataFrame:
    """(path, first_seen, last_seen, events): each path once its burst is over, by
    a state of one row a path with an event-time timer."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(first, unit="ms"), pd.Timestamp(last, unit="ms"), n)], columns=["path", "first_seen", "last_seen", "events"])
            return
        first, last, n = state.get if state.exists else (2**62, -(2**62), 0)
        for b in batches:
            ms = b["ts"].astype("datetime64[ms]").astype("int64")
            first, last, n = min(first, int(ms.min())), max(last, int(ms.max())), n + len(b)
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(last + timeout_ms, state.getCurrentWatermarkMs() + 1))

    e = events.select("path", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", WATERMARK)
    return e.groupBy("path").applyInPandasWithState(step, "path string, first_seen timestamp, last_seen timestamp, events long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
