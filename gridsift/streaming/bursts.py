"""Event-time forms of the burst and window statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.operators.ledger import window_stats


def debounce_stream(
    events: DataFrame, path: str, ts: str, event_id: str, gap: str, watermark: bool = True
) -> DataFrame:
    """The last event of each burst of a path, once the gap has passed.

    Sessions close when no event follows within the gap.  With a watermark (append
    mode) state is dropped as bursts end and later events open a new burst;
    without one (complete mode) all bursts are kept, for bounded checks.  Set
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` on the
    session to merge before the shuffle as well: a busy path then moves bursts, not events.
    """
    timed = events.withColumn("_at", F.col(ts).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("_at", gap)
    bursts = timed.groupBy(F.col(path), F.session_window("_at", gap).alias("_burst")).agg(
        F.max(F.struct("_at", F.col(event_id).alias("_id"))).alias("_last")
    )
    return bursts.select(
        path, F.col("_last._id").alias(event_id), F.col("_last._at").alias("stable_ts")
    )


def window_stats_stream(
    events: DataFrame, ts: str, failed: Column, width: str = "5 minutes", delay: str | None = None
) -> DataFrame:
    """Streaming form of ``window_stats``; ``delay`` sets the watermark for append mode."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if delay:
        timed = timed.withWatermark(ts, delay)
    return window_stats(timed, ts, failed, width)
