"""The run ledger: file events, attempts, operation records and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.functions import backoff
from gridsift.plans import join_small, next_value, number_since, number_within, running_max_before
from gridsift.session import materialize
from gridsift.settings import RetrySettings


def _count_if(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")


def unprocessed(files: DataFrame, ledger: DataFrame, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """Files that are new or newer than their last processed state."""
    last = ledger.groupBy(path).agg(F.max(mtime).alias("_last"))
    joined = join_small(files, last, [path], "left")
    return joined.where(F.col("_last").isNull() | (F.col(mtime) > F.col("_last"))).drop("_last")


def changed_only(events: DataFrame, path: str, order: list[str], mtime: str) -> DataFrame:
    """File events whose modification time exceeds every earlier one of that path."""
    seen = running_max_before(events, [path], order, mtime, "_seen")
    return seen.where(F.col("_seen").isNull() | (F.col(mtime) > F.col("_seen"))).drop("_seen")


def debounce(events: DataFrame, path: str, ts: str, event_id: str, gap_seconds: int) -> DataFrame:
    """The last event of each burst: no other event of the path within the gap after it.

    Two events in the same gap-wide slot are less than a gap apart, so only the
    last event of a slot can end a burst.  Slots are reduced map-side before the
    look at the next slot; a busy path costs one row per slot.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    timed = events.select(path, F.col(event_id), micros.alias("_at"), F.floor(micros / gap).alias("_slot"))
    slots = timed.groupBy(path, "_slot").agg(
        F.min("_at").alias("_from"),
        F.max(F.struct("_at", event_id)).alias("_last"),
        F.count(F.lit(1)).alias("_events"),
    )
    slots = next_value(materialize(slots), [path], ["_slot"], "_from", "_next")
    ends = F.col("_next").isNull() | (F.col("_next") - F.col("_last._at") >= gap)
    return slots.where(ends).select(
        path,
        F.col(f"_last.{event_id}").alias(event_id),
        F.timestamp_micros(F.col("_last._at")).alias("stable_ts"),
    )


def attempts(
    outcomes: DataFrame,
    path: str,
    ts: str,
    event_id: str,
    retry: RetrySettings = RetrySettings(),
    success: str | None = None,
) -> DataFrame:
    """Number the failures of each path and say when the next try is due.

    With a ``success`` column the count starts over after every success.
    """
    if success is None:
        numbered = number_within(outcomes, [path], [ts, event_id], "attempt")
    else:
        known = outcomes.where(F.col(success).isNotNull())
        numbered = number_since(known, [path], [ts, event_id], success, "attempt").where(~F.col(success))
    exhausted = F.col("attempt") >= retry.max_attempts
    delay = F.when(~exhausted, backoff(F.col("attempt") - 1, retry))
    due = F.timestamp_micros(
        F.unix_micros(F.col(ts).cast("timestamp")) + (F.col("delay_seconds") * 1_000_000).cast("long")
    )
    return (
        numbered.withColumn("exhausted", exhausted)
        .withColumn("delay_seconds", delay)
        .withColumn("next_attempt_ts", due)
    )


def op_summary(ops: DataFrame, op: str | None = None) -> DataFrame:
    """Totals, outcome counts and durations per operation, plus one row for all (null name).

    Expects ``operation_name, success, duration_ms``.  The overall row is rolled up
    from the per-operation sums, so the records are aggregated once.
    """
    if op is not None:
        ops = ops.where(F.col("operation_name") == op)
    done = F.col("success").isNotNull()
    lasted = F.when(done, F.col("duration_ms"))
    per_op = ops.groupBy("operation_name").agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(done).alias("completed"),
        _count_if(F.col("success")).alias("succeeded"),
        _count_if(~F.col("success")).alias("failed"),
        F.count(lasted).alias("timed"),
        F.sum(lasted).alias("duration"),
        F.min(lasted).alias("shortest"),
        F.max(lasted).alias("longest"),
    )
    rolled = per_op.rollup("operation_name").agg(
        F.sum("total").alias("total_operations"),
        F.sum("completed").alias("completed_operations"),
        F.sum("succeeded").alias("successful_operations"),
        F.sum("failed").alias("failed_operations"),
        F.sum("duration").alias("total_duration_ms"),
        F.min("shortest").alias("min_duration_ms"),
        F.max("longest").alias("max_duration_ms"),
        F.sum("timed").alias("_timed"),
    )
    completed = F.col("completed_operations")
    rate = F.coalesce(F.col("successful_operations") / F.nullif(completed, F.lit(0)), F.lit(0.0))
    mean = F.col("total_duration_ms") / F.nullif(F.col("_timed"), F.lit(0))
    return rolled.withColumn("success_rate", rate).withColumn("avg_duration_ms", mean).drop("_timed")


def error_breakdown(ops: DataFrame, operation: str | None = None, by_operation: bool = False) -> DataFrame:
    """Failed operations per error type: of all, of one operation, or of each."""
    failed = ops.where(~F.col("success"))
    if operation is not None:
        failed = failed.where(F.col("operation_name") == operation)
    return failed.groupBy(*["operation_name"] * by_operation, F.coalesce("error_type", F.lit("Unknown")).alias("error_type")).agg(
        F.count(F.lit(1)).alias("errors")
    )


def error_map(ops: DataFrame) -> DataFrame:
    """The error breakdown as one map; it has one entry per error type."""
    counts = error_breakdown(ops)
    entries = F.sort_array(F.collect_list(F.struct("error_type", "errors")))
    return counts.agg(F.map_from_entries(entries).alias("error_breakdown"))


def recent(ops: DataFrame, ts: str, event_id: str, n: int = 100) -> DataFrame:
    """The last n operations."""
    return ops.orderBy(F.desc(ts), F.desc(event_id)).limit(n)


def errors_only(log: DataFrame) -> DataFrame:
    return log.where(F.col("level") == "ERROR")


def outcome_counts(log: DataFrame) -> DataFrame:
    """Records and mean duration per outcome."""
    return log.groupBy("success").agg(
        F.count(F.lit(1)).alias("records"), F.avg("duration_ms").alias("mean_duration_ms")
    )


def trace_rollup(ops: DataFrame) -> DataFrame:
    """Operations that share a correlation id: span, counts, and operations by first use.

    Expects ``correlation_id, operation_name, start_ts, success, op_id``.  Records are
    first reduced to one row per id and operation name, so the list of an id is
    as long as its set of operation names, however many records it has.
    ``trace_steps`` lists every single step.
    """
    per_op = ops.groupBy("correlation_id", "operation_name").agg(
        F.min(F.struct("start_ts", "op_id")).alias("_first"),
        F.max("start_ts").alias("_last"),
        F.count(F.lit(1)).alias("_steps"),
        _count_if(~F.col("success")).alias("_failed"),
    )
    used = F.array_sort(F.collect_list(F.struct("_first", "operation_name")))
    return per_op.groupBy("correlation_id").agg(
        F.min("_first.start_ts").alias("first_ts"),
        F.max("_last").alias("last_ts"),
        F.sum("_steps").alias("steps"),
        F.sum("_failed").alias("failures"),
        F.transform(used, lambda u: u["operation_name"]).alias("operations"),
    )


def trace_steps(ops: DataFrame) -> DataFrame:
    """Every operation with its step number within its correlation id."""
    return number_within(ops, ["correlation_id"], ["start_ts", "op_id"], "step")


def threshold_alert(metrics: DataFrame, value: str, limit: float, metric: str) -> DataFrame:
    """Measurements above the limit, with the warning text."""
    over = metrics.where(F.col(value) > limit)
    text = F.concat(
        F.lit("Performance warning: "), F.col(metric), F.lit("="), F.col(value).cast("string"),
        F.lit(f" exceeds threshold {limit}"),
    )
    return over.withColumn("warning", text)


def retention(log: DataFrame, days: int, asof: Column, log_date: str = "log_date") -> DataFrame:
    """Drop log days older than ``days``; 0 or less keeps everything.  Prunes partitions."""
    if days <= 0:
        return log
    return log.where(F.col(log_date) >= F.date_sub(asof, days))


def window_stats(events: DataFrame, ts: str, failed: Column, width: str = "5 minutes") -> DataFrame:
    """Events, failures and failure rate per fixed time window (batch or stream)."""
    grouped = events.groupBy(F.window(F.col(ts).cast("timestamp"), width).alias("_w")).agg(
        F.count(F.lit(1)).alias("events"), _count_if(failed).alias("failures")
    )
    return grouped.select(
        F.col("_w.start").alias("window_start"),
        "events", "failures",
        (F.col("failures") / F.col("events")).alias("failure_rate"),
    )


def run_stats(decisions: DataFrame) -> DataFrame:
    """Run totals from per-table decisions.

    Expects booleans ``accepted``, ``delivered``, ``failed`` and ``archived``
    (null = no archive tried).  Rates are percentages, null if nothing was tried.
    """
    totals = decisions.agg(
        F.count(F.lit(1)).alias("tables_analyzed"),
        _count_if(F.col("accepted")).alias("tables_accepted"),
        _count_if(F.col("delivered")).alias("files_generated"),
        _count_if(F.col("failed")).alias("processing_errors"),
        _count_if(F.col("archived")).alias("files_archived"),
        _count_if(~F.col("archived")).alias("archive_failures"),
    )
    tried = F.col("files_archived") + F.col("archive_failures")
    return totals.select(
        "*",
        (F.col("tables_accepted") * 100 / F.nullif(F.col("tables_analyzed"), F.lit(0))).alias("acceptance_rate"),
        (F.col("files_archived") * 100 / F.nullif(tried, F.lit(0))).alias("archive_success_rate"),
    )


def file_outcome(decisions: DataFrame, source: str = "source") -> DataFrame:
    """Result per source: success if something was delivered or nothing qualified."""
    per = decisions.groupBy(source).agg(
        F.count(F.lit(1)).alias("tables"),
        _count_if(F.col("accepted")).alias("qualified"),
        _count_if(F.col("delivered")).alias("delivered"),
    )
    return per.select(
        "*",
        (F.col("qualified") / F.col("tables")).alias("qualification_rate"),
        F.when(F.col("qualified") > 0, F.col("delivered") / F.col("qualified")).otherwise(F.lit(1.0)).alias("delivery_rate"),
        ((F.col("delivered") > 0) | (F.col("qualified") == 0)).alias("success"),
    )


def to_record(log: DataFrame) -> DataFrame:
    """Log rows as one JSON text each."""
    return log.select(F.to_json(F.struct("*")).alias("record"))


def from_record(records: DataFrame, schema: str, column: str = "record") -> DataFrame:
    """JSON texts back to columns; a malformed record gives nulls."""
    return records.select(F.from_json(F.col(column), schema).alias("_r")).select("_r.*")
