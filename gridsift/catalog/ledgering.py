"""Queries on the run ledger, with ``events`` as the record of operations and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.catalog import query
from gridsift.catalog import sql as Q
from gridsift.catalog.corpora import DIRTY, sources_of
from gridsift.operators import confidence as C
from gridsift.operators import delivery as V
from gridsift.operators import ledger as L

OPS_SQL = """ops AS (
  SELECT event_id AS op_id, event_type AS operation_name, user_id AS correlation_id, epoch_us(ts) AS start_us,
    value AS duration_ms, CASE WHEN value < 2 THEN NULL ELSE event_type <> 'error' AND value < 150 END AS success,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'E' || (event_id % 5) END AS error_type
  FROM events
)"""


def _events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _ops(spark, sf_dir):
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("op_id"),
        F.col("event_type").alias("operation_name"),
        F.col("user_id").alias("correlation_id"),
        F.col("ts").alias("start_ts"),
        F.col("value").alias("duration_ms"),
        F.expr("CASE WHEN value < 2 THEN NULL ELSE event_type <> 'error' AND value < 150 END").alias("success"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'E' || (event_id % 5) END").alias("error_type"),
    )


_SUMMARY = """
SELECT {group} AS operation_name, count(*) AS total_operations, count(success) AS completed_operations,
  count(*) FILTER (WHERE success) AS successful_operations, count(*) FILTER (WHERE NOT success) AS failed_operations,
  round(sum(duration_ms) FILTER (WHERE success IS NOT NULL), 4) AS total_duration_ms,
  min(duration_ms) FILTER (WHERE success IS NOT NULL) AS min_duration_ms,
  max(duration_ms) FILTER (WHERE success IS NOT NULL) AS max_duration_ms,
  round(CAST(count(*) FILTER (WHERE success) AS DOUBLE) / count(success), 6) AS success_rate,
  round(avg(duration_ms) FILTER (WHERE success IS NOT NULL), 6) AS avg_duration_ms
FROM ops {tail}"""


def _summary(df):
    return (
        df.withColumn("total_duration_ms", F.round("total_duration_ms", 4))
        .withColumn("success_rate", F.round("success_rate", 6))
        .withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))
    )


@query("WITH " + OPS_SQL + _SUMMARY.format(group="operation_name", tail="GROUP BY ROLLUP (operation_name)"))
def op_summary_rollup(spark, sf_dir):
    return _summary(L.op_summary(_ops(spark, sf_dir)))


@query("WITH " + OPS_SQL + _SUMMARY.format(group="operation_name", tail="WHERE operation_name = 'purchase' GROUP BY ROLLUP (operation_name)"))
def op_summary_one(spark, sf_dir):
    """The summary of a single operation."""
    return _summary(L.op_summary(_ops(spark, sf_dir), "purchase"))


@query("WITH " + OPS_SQL + """
SELECT coalesce(error_type, 'Unknown') AS error_type, count(*) AS errors FROM ops WHERE NOT success GROUP BY 1""")
def error_breakdown(spark, sf_dir):
    return L.error_breakdown(_ops(spark, sf_dir))


@query("WITH " + OPS_SQL + """
SELECT operation_name, coalesce(error_type, 'Unknown') AS error_type, count(*) AS errors FROM ops WHERE NOT success GROUP BY 1, 2""")
def error_breakdown_by_operation(spark, sf_dir):
    return L.error_breakdown(_ops(spark, sf_dir), by_operation=True)


@query("WITH " + OPS_SQL + """,
counts AS (SELECT coalesce(error_type, 'Unknown') AS error_type, count(*) AS errors FROM ops WHERE NOT success GROUP BY 1)
SELECT string_agg(error_type || '=' || errors, ',' ORDER BY error_type) AS error_breakdown FROM counts""")
def error_map(spark, sf_dir):
    pairs = F.transform(
        F.array_sort(F.map_entries("error_breakdown")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return L.error_map(_ops(spark, sf_dir)).select(F.array_join(pairs, ",").alias("error_breakdown"))


@query("WITH " + OPS_SQL + """
SELECT op_id, operation_name, start_us FROM ops ORDER BY start_us DESC, op_id DESC LIMIT 100""")
def recent_ops(spark, sf_dir):
    recent = L.recent(_ops(spark, sf_dir), "start_ts", "op_id", 100)
    return recent.select("op_id", "operation_name", F.unix_micros("start_ts").alias("start_us"))


def _log(spark, sf_dir):
    level = F.when(F.col("operation_name") == "error", "ERROR").otherwise("INFO")
    return _ops(spark, sf_dir).withColumn("level", level)


@query("SELECT event_id AS op_id, user_id AS correlation_id FROM events WHERE event_type = 'error'")
def log_errors(spark, sf_dir):
    return L.errors_only(_log(spark, sf_dir)).select("op_id", "correlation_id")


@query("WITH " + OPS_SQL + """
SELECT success, count(*) AS records, round(avg(duration_ms), 6) AS mean_duration_ms FROM ops GROUP BY success""")
def log_outcomes(spark, sf_dir):
    counts = L.outcome_counts(_log(spark, sf_dir))
    return counts.withColumn("mean_duration_ms", F.round("mean_duration_ms", 6))


@query("WITH " + OPS_SQL + """,
firsts AS (
  SELECT correlation_id, operation_name, min(start_us) AS first_at, arg_min(op_id, (start_us, op_id)) AS id
  FROM ops GROUP BY ALL
),
used AS (
  SELECT correlation_id, string_agg(operation_name, ',' ORDER BY first_at, id) AS operations FROM firsts GROUP BY 1
)
SELECT correlation_id, min(start_us) AS first_us, max(start_us) AS last_us, count(*) AS steps,
  count(*) FILTER (WHERE NOT success) AS failures, any_value(operations) AS operations
FROM ops JOIN used USING (correlation_id) GROUP BY correlation_id""")
def trace_rollup(spark, sf_dir):
    traces = L.trace_rollup(_ops(spark, sf_dir))
    return traces.select(
        "correlation_id",
        F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"),
        "steps", "failures",
        F.array_join("operations", ",").alias("operations"),
    )


@query("WITH " + OPS_SQL + """
SELECT correlation_id, op_id, row_number() OVER (PARTITION BY correlation_id ORDER BY start_us, op_id) AS step FROM ops""")
def trace_steps(spark, sf_dir):
    return L.trace_steps(_ops(spark, sf_dir)).select("correlation_id", "op_id", "step")


@query("""
SELECT event_id, 'Performance warning: ' || event_type || '=' || cast(cast(value as decimal(18,2)) as varchar)
  || ' exceeds threshold 100' AS warning
FROM events WHERE value > 100""")
def threshold_alert(spark, sf_dir):
    money = _events(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,2)"))
    return L.threshold_alert(money, "value", 100, "event_type").select("event_id", "warning")


@query("""
SELECT event_id, epoch_us(ts) AS at_us FROM events
WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 7""")
def retention_filter(spark, sf_dir):
    """The last days of the log, counted from its newest day."""
    log = _events(spark, sf_dir).withColumn("log_date", F.to_date("ts"))
    newest = log.agg(F.max("log_date").alias("day")).first()["day"]
    kept = L.retention(log, 7, F.lit(newest))
    return kept.select("event_id", F.unix_micros("ts").alias("at_us"))


@query("""
SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS window_us, count(*) AS events,
  count(*) FILTER (WHERE event_type = 'error') AS failures,
  round(CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*), 6) AS failure_rate
FROM events GROUP BY 1""")
def window_stats_5m(spark, sf_dir):
    stats = L.window_stats(_events(spark, sf_dir), "ts", F.col("event_type") == "error")
    return stats.select(
        F.unix_micros("window_start").alias("window_us"), "events", "failures",
        F.round("failure_rate", 6).alias("failure_rate"),
    )


DEBOUNCE_SQL = """
SELECT user_id, event_id, epoch_us(ts) AS stable_us FROM (
  SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events
) WHERE next_ts IS NULL OR epoch_us(next_ts) - epoch_us(ts) >= 21600000000"""


@query(DEBOUNCE_SQL)
def debounce_events(spark, sf_dir):
    """Last event of each burst per user, with a gap of six hours."""
    ends = L.debounce(_events(spark, sf_dir), "user_id", "ts", "event_id", 6 * 3600)
    return ends.select("user_id", "event_id", F.unix_micros("stable_ts").alias("stable_us"))


@query("""
SELECT event_id, user_id, value FROM (
  SELECT event_id, user_id, value, max(value) OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM events) WHERE seen IS NULL OR value > seen""")
def changed_only(spark, sf_dir):
    """Events whose value exceeds all earlier ones of the user (value as modification time)."""
    changed = L.changed_only(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value")
    return changed.select("event_id", "user_id", "value")


_WAIT = "CASE WHEN attempt < 3 THEN CASE WHEN attempt <= 1 THEN 5e0 ELSE least(5e0 * power(2, attempt - 1), 60e0) END END"


@query(f"""
WITH failures AS (
  SELECT event_id, user_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt
  FROM events WHERE event_type = 'error'
)
SELECT event_id, user_id, attempt, attempt >= 3 AS exhausted, {_WAIT} AS delay_seconds,
  CAST(at_us + {_WAIT} * 1000000 AS BIGINT) AS next_us
FROM failures""")
def retry_schedule(spark, sf_dir):
    """Attempt numbers and retry times of all failures of a user."""
    failures = _events(spark, sf_dir).where("event_type = 'error'")
    rows = L.attempts(failures, "user_id", "ts", "event_id")
    return rows.select(
        "event_id", "user_id", F.col("attempt").cast("long").alias("attempt"), "exhausted", "delay_seconds",
        F.unix_micros("next_attempt_ts").alias("next_us"),
    )


@query("""
WITH runs AS (
  SELECT event_id, user_id, ts, event_type, count(*) FILTER (WHERE event_type <> 'error') OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run
  FROM events
)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS attempt
FROM runs WHERE event_type = 'error'""")
def retry_after_success(spark, sf_dir):
    """Attempt numbers that start over after a success."""
    outcomes = _events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    rows = L.attempts(outcomes, "user_id", "ts", "event_id", success="ok")
    return rows.select("event_id", "user_id", F.col("attempt").cast("long").alias("attempt"))


@query("""
WITH ledger AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id, e.user_id FROM events e LEFT JOIN ledger l USING (user_id)
WHERE e.event_type = 'view' AND (last IS NULL OR e.ts > last)""")
def unprocessed(spark, sf_dir):
    """File events newer than the last processed state of their path."""
    events = _events(spark, sf_dir)
    files = events.where("event_type = 'view'").select("event_id", F.col("user_id").alias("path"), F.col("ts").alias("mtime"))
    done = events.where("event_type = 'purchase'").select(F.col("user_id").alias("path"), F.col("ts").alias("mtime"))
    return L.unprocessed(files, done).select("event_id", F.col("path").alias("user_id"))


@query("""
WITH sheets AS (
  SELECT 'orders' AS source_path, cast(o_custkey as varchar) AS sheet_name, count(*) AS nrows FROM orders GROUP BY ALL
), facts AS (
  SELECT 'orders' AS source_path, cast(c_custkey as varchar) AS sheet_name, c_mktsegment AS sheet_state
  FROM customer WHERE c_acctbal > 3000
)
SELECT source_path, sheet_name, nrows, sheet_state FROM sheets LEFT JOIN facts USING (source_path, sheet_name)""")
def attach_metadata(spark, sf_dir):
    """Facts by workbook and sheet; sheets without facts stay."""
    sheets = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(
        F.lit("orders").alias("source_path"), F.col("o_custkey").cast("string").alias("sheet_name")
    ).agg(F.count(F.lit(1)).alias("nrows"))
    facts = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 3000").select(
        F.lit("orders").alias("source_path"),
        F.col("c_custkey").cast("string").alias("sheet_name"),
        F.col("c_mktsegment").alias("sheet_state"),
    )
    return V.attach_metadata(sheets, facts)


_DECISIONS = """decided AS (
  SELECT table_id, regexp_extract(table_id, '^[a-z]+') AS source, round(overall, 12) >= 7e-1 AS accepted,
    round(overall, 12) >= 7e-1 AND header_score >= 9e-1 AS delivered, nrows < 5 AS failed,
    CASE WHEN round(overall, 12) >= 7e-1 THEN header_score >= 95e-2 END AS archived
  FROM judged
)"""


def _decisions(spark, sf_dir):
    scores = C.confidence(sources_of(spark, sf_dir, DIRTY))
    return scores.select(
        "table_id",
        F.regexp_extract("table_id", "^[a-z]+", 0).alias("source"),
        "accepted",
        (F.col("accepted") & (F.col("header_score") >= 0.9)).alias("delivered"),
        (F.col("rows") < 5).alias("failed"),
        F.when(F.col("accepted"), F.col("header_score") >= 0.95).alias("archived"),
    )


@query(Q.with_corpus(DIRTY, *Q.ALL_PARTS, _DECISIONS, query="""
SELECT count(*) AS tables_analyzed, count(*) FILTER (WHERE accepted) AS tables_accepted,
  count(*) FILTER (WHERE delivered) AS files_generated, count(*) FILTER (WHERE failed) AS processing_errors,
  count(*) FILTER (WHERE archived) AS files_archived, count(*) FILTER (WHERE NOT archived) AS archive_failures,
  round(100e0 * count(*) FILTER (WHERE accepted) / nullif(count(*), 0), 6) AS acceptance_rate,
  round(100e0 * count(*) FILTER (WHERE archived) / nullif(count(archived), 0), 6) AS archive_success_rate
FROM decided"""))
def run_stats(spark, sf_dir):
    stats = L.run_stats(_decisions(spark, sf_dir))
    for name in ("acceptance_rate", "archive_success_rate"):
        stats = stats.withColumn(name, F.round(name, 6))
    return stats


@query(Q.with_corpus(DIRTY, *Q.ALL_PARTS, _DECISIONS, query="""
SELECT source, count(*) AS tables, count(*) FILTER (WHERE accepted) AS qualified,
  count(*) FILTER (WHERE delivered) AS delivered,
  round(CAST(count(*) FILTER (WHERE accepted) AS DOUBLE) / count(*), 6) AS qualification_rate,
  CASE WHEN count(*) FILTER (WHERE accepted) > 0
    THEN round(CAST(count(*) FILTER (WHERE delivered) AS DOUBLE) / count(*) FILTER (WHERE accepted), 6) ELSE 1e0 END AS delivery_rate,
  count(*) FILTER (WHERE delivered) > 0 OR count(*) FILTER (WHERE accepted) = 0 AS success
FROM decided GROUP BY source"""))
def file_outcome(spark, sf_dir):
    outcome = L.file_outcome(_decisions(spark, sf_dir))
    for name in ("qualification_rate", "delivery_rate"):
        outcome = outcome.withColumn(name, F.round(name, 6))
    return outcome


@query(Q.with_corpus(DIRTY, *Q.ALL_PARTS, query="""
SELECT table_id, CASE WHEN nrows < 45 THEN 'failed' WHEN round(overall, 12) >= 7e-1 THEN 'accepted' ELSE 'rejected' END AS decision
FROM judged"""))
def route(spark, sf_dir):
    """Accepted, rejected or failed; here small worksheets count as failed."""
    scores = C.confidence(sources_of(spark, sf_dir, DIRTY))
    failures = scores.where("rows < 45").select("table_id")
    return V.route(scores, failures).select("table_id", "decision")


@query("""
SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events""")
def json_records(spark, sf_dir):
    """Records to JSON text and back."""
    events = _events(spark, sf_dir).select("event_id", F.from_json("props", "k int").alias("p"))
    records = L.to_record(events.select("event_id", "p.k"))
    return L.from_record(records, "event_id bigint, k int")
