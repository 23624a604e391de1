"""Queries that run a stream to its end; each has a batch result to equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.catalog import query
from gridsift.catalog import sql as Q
from gridsift.catalog.corpora import SHEETS, sources_of  # noqa: F401
from gridsift.catalog.delivering import scratch
from gridsift.catalog.ledgering import DEBOUNCE_SQL
from gridsift.operators.grid import GridSource, to_grid
from gridsift.streaming import bursts as B
from gridsift.streaming import files as S
from gridsift.streaming import ledgers as Z

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: Events arrive in so many parts, by time.
PARTS = 5
JUDGED = tuple(s for s in SHEETS if s.table == "events")


def _events(spark, sf_dir):
    return S.stream_rows(spark, sf_dir, EVENTS, glob="events.parquet")


def _finish(spark, stream, label, mode):
    """Run to the end of the input and return the last result table."""
    out, checkpoint = scratch(spark, label), scratch(spark, f"{label}-state")

    def work(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    S.run_available(S.each_batch(stream, checkpoint, work).outputMode(mode))
    rows = spark.read.option("basePath", out).parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("batch_id").alias("last")).first()["last"]
        rows = rows.where(F.col("batch_id") == last)
    return rows.drop("batch_id")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_ingest(spark, sf_dir):
    """A file stream read to its end, exactly once."""
    rows = _finish(spark, _events(spark, sf_dir), "ingest", "append")
    return rows.select("event_id", "user_id", "event_type")


@query(DEBOUNCE_SQL)
def debounce_stream(spark, sf_dir):
    """Bursts by session window; equals the batch form."""
    stream = B.debounce_stream(_events(spark, sf_dir), "user_id", "ts", "event_id", "6 hours", watermark=False)
    ends = _finish(spark, stream, "bursts", "complete")
    return ends.select("user_id", "event_id", F.unix_micros("stable_ts").alias("stable_us"))


@query("""
SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS window_us, count(*) AS events,
  count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1""")
def window_stats_stream(spark, sf_dir):
    """Five-minute statistics kept by a stream; equals the batch form."""
    stream = B.window_stats_stream(_events(spark, sf_dir), "ts", F.col("event_type") == "error")
    stats = _finish(spark, stream, "stats", "complete")
    return stats.select(F.unix_micros("window_start").alias("window_us"), "events", "failures")


def _arriving(spark, sf_dir, label, writer):
    """Run a stream over ``events`` as they arrive: ``PARTS`` files folders by time, a batch or more for each."""
    inbox, state = scratch(spark, label), scratch(spark, f"{label}-state")
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    span = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("b")).first()
    width = ((span["b"] or 0) - (span["a"] or 0)) // PARTS + 1
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(span["a"] or 0)) / F.lit(width))
    for number in range(PARTS):
        events.where(part == number).write.mode("append").parquet(inbox)
        # A few files at a time would mix the parts of a run.
        stream = spark.readStream.schema(EVENTS).parquet(inbox)
        S.run_available(writer(stream).option("checkpointLocation", state))


def _kept(spark, label):
    """A batch callback that keeps its rows, and a way to read them all."""
    out = scratch(spark, label)

    def work(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return work, lambda: spark.read.option("basePath", out).parquet(out).drop("batch_id")


@query("""
SELECT event_id, user_id, value FROM (
  SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events
) WHERE user_id IS NOT NULL AND (seen IS NULL OR value > seen)""")
def changed_stream(spark, sf_dir):
    """Changes found in keyed state over several batches; equals the batch form."""
    work, rows = _kept(spark, "changes")
    _arriving(spark, sf_dir, "changed", lambda stream: Z.changed_events(stream, "user_id", ["ts", "event_id"], "value", "ts").writeStream.foreachBatch(work))
    return rows().select("event_id", "user_id", "value")


@query("""
WITH runs AS (
  SELECT event_id, user_id, ts, event_type, count(*) FILTER (WHERE event_type <> 'error') OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run
  FROM events
),
failures AS (
  SELECT event_id, user_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS attempt
  FROM runs WHERE event_type = 'error'
)
SELECT event_id, user_id::VARCHAR AS path, CAST(attempt AS INTEGER) AS attempt, attempt >= 3 AS exhausted,
  CASE WHEN attempt < 3 THEN CAST(at_us + 5000000 * power(2, attempt - 1) AS BIGINT) END AS due_us FROM failures""")
def retry_after_success_stream(spark, sf_dir):
    """Failures numbered over several batches, starting over after a success; due times kept by timers."""
    return _failures(spark, sf_dir, F.col("event_type") != "error")


@query("""
WITH failures AS (
  SELECT event_id, user_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt
  FROM events WHERE event_type = 'error'
)
SELECT event_id, user_id::VARCHAR AS path, CAST(attempt AS INTEGER) AS attempt, attempt >= 3 AS exhausted,
  CASE WHEN attempt < 3 THEN CAST(at_us + 5000000 * power(2, attempt - 1) AS BIGINT) END AS due_us FROM failures""")
def retry_stream(spark, sf_dir):
    """Attempts 1, 2, 3 and exhausted over several batches; equals the batch schedule."""
    return _failures(spark, sf_dir, F.when(F.col("event_type") == "error", False), "event_type = 'error'")


def _failures(spark, sf_dir, success, which="true"):
    work, rows = _kept(spark, "failures")

    def writer(stream):
        outcomes = stream.where(which).withColumn("ok", success)
        return Z.retry_events(outcomes, "user_id", "ts", "event_id", "ok").writeStream.foreachBatch(work)

    _arriving(spark, sf_dir, "outcomes", writer)
    return rows().where("kind = 'failed'").select("event_id", "path", "attempt", "exhausted", "due_us")


@query(Q.with_corpus(JUDGED, *Q.ALL_PARTS, query="""
SELECT table_id, nrows AS "rows", ncols AS "columns", round(density_score, 6) AS density_score, round(header_score, 6) AS header_score,
  round(consistency_score, 6) AS consistency_score, round(overall, 6) AS overall, round(overall, 12) >= 7e-1 AS accepted
FROM judged"""))
def judge_growing_stream(spark, sf_dir):
    """A table that arrives in several batches, judged from merged profiles; equals the judgement of the whole."""
    state = scratch(spark, "profiles")
    names = tuple(f.split()[0] for f in EVENTS.split(", "))
    source = spark.createDataFrame([], EVENTS)
    header = GridSource(source, "events", "event_id", names).grid()
    work = S.grow_profiles(lambda batch: to_grid(batch, "events", "event_id + 1", names, header=False, double_scale=2), state, header)
    _arriving(spark, sf_dir, "growing", lambda stream: stream.writeStream.foreachBatch(work))
    rows = S.judge_kept(spark, state)
    parts = [F.round(c, 6).alias(c) for c in ("density_score", "header_score", "consistency_score", "overall")]
    return rows.select("table_id", "rows", "columns", *parts, "accepted")


@query(Q.with_corpus(JUDGED, *Q.ALL_PARTS, query="""
SELECT table_id, nrows AS "rows", ncols AS "columns", round(overall, 6) AS overall, round(overall, 12) >= 7e-1 AS accepted
FROM judged"""))
def judge_stream(spark, sf_dir):
    """Micro-batches judged and delivered as they arrive."""
    scores, deliver = scratch(spark, "scores"), scratch(spark, "delivered")
    work = S.judge_batches(
        lambda batch: to_grid(batch, "events", "event_id", double_scale=2), scores, deliver
    )
    S.run_available(S.each_batch(_events(spark, sf_dir), scratch(spark, "scores-state"), work))
    rows = spark.read.option("basePath", scores).parquet(scores)
    return rows.select("table_id", "rows", "columns", F.round("overall", 6).alias("overall"), "accepted")
