from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridsift.operators import ledger as L
from gridsift.operators.observe import OperationLog
from gridsift.settings import RetrySettings

T0 = datetime(2024, 1, 1)


def _events(spark, spec):
    rows = [(i, path, T0 + timedelta(seconds=s), extra) for i, (path, s, extra) in enumerate(spec)]
    return spark.createDataFrame(rows, "id int, path string, ts timestamp, extra string")


def test_debounce(spark):
    spec = [("a", 0, ""), ("a", 1.5, ""), ("a", 3.5, ""), ("a", 5.4, ""), ("a", 9, ""), ("b", 0, ""), ("a", 9, "")]
    ends = L.debounce(_events(spark, spec), "path", "ts", "id", 2).collect()
    assert sorted((r["path"], r["id"]) for r in ends) == [("a", 1), ("a", 3), ("a", 6), ("b", 5)]


def test_changed_only_and_unprocessed(spark):
    events = _events(spark, [("a", 0, "5"), ("a", 1, "5"), ("a", 2, "7"), ("a", 3, "6"), ("b", 4, "1")])
    events = events.withColumn("m", F.col("extra").cast("int"))
    assert sorted(r["id"] for r in L.changed_only(events, "path", ["ts", "id"], "m").collect()) == [0, 2, 4]
    ledger = spark.createDataFrame([("a", 5), ("a", 3)], "path string, m int")
    assert sorted(r["id"] for r in L.unprocessed(events, ledger, "path", "m").collect()) == [2, 3, 4]


def test_attempts(spark):
    events = _events(spark, [("a", i, ok) for i, ok in enumerate("ffffsff")]).withColumn("ok", F.col("extra") == "s")
    failures = L.attempts(events.where("extra = 'f'"), "path", "ts", "id").orderBy("id").collect()
    assert [r["attempt"] for r in failures] == [1, 2, 3, 4, 5, 6]
    assert [r["exhausted"] for r in failures] == [False, False, True, True, True, True]
    assert [r["delay_seconds"] for r in failures][:3] == [5.0, 10.0, None]
    assert failures[1]["next_attempt_ts"] == T0 + timedelta(seconds=11)
    fresh = L.attempts(events, "path", "ts", "id", success="ok").orderBy("id").collect()
    assert [r["attempt"] for r in fresh] == [1, 2, 3, 4, 1, 2]


def test_run_stats_without_tries(spark):
    schema = "accepted boolean, delivered boolean, failed boolean, archived boolean"
    nothing = L.run_stats(spark.createDataFrame([], schema)).first()
    assert nothing["tables_analyzed"] == 0 and nothing["acceptance_rate"] is None
    some = L.run_stats(spark.createDataFrame([(True, True, False, None), (False, False, True, None)], schema)).first()
    assert some["acceptance_rate"] == 50.0 and some["archive_success_rate"] is None


def test_file_outcome(spark):
    rows = [("x", True, False), ("x", False, False), ("y", False, False), ("z", True, True)]
    df = spark.createDataFrame(rows, "source string, accepted boolean, delivered boolean")
    got = {r["source"]: (r["success"], r["qualification_rate"], r["delivery_rate"]) for r in L.file_outcome(df).collect()}
    assert got == {"x": (False, 0.5, 0.0), "y": (True, 0.0, 1.0), "z": (True, 1.0, 1.0)}


def test_op_summary_counts_incomplete(spark):
    ops = spark.createDataFrame(
        [("read", True, 10.0), ("read", False, 30.0), ("read", None, 99.0), ("write", None, None)],
        "operation_name string, success boolean, duration_ms double",
    )
    rows = {r["operation_name"]: r for r in L.op_summary(ops).collect()}
    assert rows["read"]["total_operations"] == 3 and rows["read"]["completed_operations"] == 2
    assert rows["read"]["avg_duration_ms"] == 20.0 and rows["read"]["success_rate"] == 0.5
    assert rows["write"]["success_rate"] == 0.0 and rows["write"]["avg_duration_ms"] is None
    assert rows[None]["total_operations"] == 4


def test_operation_log(spark):
    log = OperationLog(spark, "run-1")
    log.observed("count", spark.range(100), lambda df: df.collect(), rows=F.count(F.lit(1)), top=F.max("id"))
    with pytest.raises(KeyError):
        with log.operation("broken"):
            raise KeyError("x")
    rows = {r["operation_name"]: r for r in log.ops().collect()}
    assert rows["count"]["metadata"] == {"rows": "100", "top": "99"} and rows["count"]["success"]
    assert rows["broken"]["error_type"] == "KeyError" and not rows["broken"]["success"]
    assert L.error_breakdown(log.ops()).first()["error_type"] == "KeyError"


def test_retry_settings_are_checked():
    for bad in ({"max_attempts": 0}, {"delay": 0}, {"backoff_factor": 0.5}, {"max_delay": -1}):
        with pytest.raises(ValueError):
            RetrySettings(**bad)


def test_retention_keeps_all_when_off(spark):
    log = spark.createDataFrame([("2024-01-01",), ("2024-01-09",)], "d string").select(F.to_date("d").alias("log_date"))
    asof = F.to_date(F.lit("2024-01-10"))
    assert L.retention(log, 0, asof).count() == 2 and L.retention(log, 3, asof).count() == 1
