import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gridsift.operators import ledger as L
from gridsift.operators.observe import OperationLog


def _wait(listener, runs, seconds=30):
    """Listener events come after the stream has ended."""
    end = time.time() + seconds
    while time.time() < end and not set(runs) <= listener.ended:
        time.sleep(0.1)


def _files(spark, folder, n):
    for i in range(n):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_runs_become_operation_records(spark, tmp_path):
    log = OperationLog(spark, "run")
    stream = _files(spark, str(tmp_path / "in"), 3)
    counts = stream.groupBy((F.col("id") % 4).alias("k")).count()
    with log.streams() as listener:
        good = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "good"))
        good = good.trigger(availableNow=True).start()
        good.awaitTermination()
        bad = stream.select(F.raise_error(F.lit("no"))).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "bad"))
        bad = bad.trigger(availableNow=True).start()
        with pytest.raises(StreamingQueryException):
            bad.awaitTermination()
        _wait(listener, [str(good.runId), str(bad.runId)])
    rows = log.ops().collect()
    batches = [r for r in rows if r["operation_name"] == "stream_batch" and r["correlation_id"] == str(good.runId)]
    read = [r for r in batches if r["metadata"]["rows"] != "0"]
    assert [(r["metadata"]["batch_id"], r["metadata"]["rows"]) for r in read] == [("0", "10"), ("1", "10"), ("2", "10")]
    assert {r["metadata"]["stream"] for r in read} == {"counts"} and read[-1]["metadata"]["state_rows"] == "4"
    assert all(r["success"] and r["duration_ms"] > 0 for r in batches) and len({r["op_id"] for r in rows}) == len(rows)
    runs = {r["correlation_id"]: r for r in rows if r["operation_name"] == "stream_run"}
    assert runs[str(good.runId)]["success"] and not runs[str(bad.runId)]["success"]
    assert runs[str(bad.runId)]["error_type"] and "no" in runs[str(bad.runId)]["metadata"]["error"]

    # The records feed the same reports as those of batch operations.
    summary = {r["operation_name"]: r for r in L.op_summary(log.ops()).collect()}
    assert set(summary) == {None, "stream_batch", "stream_run"}  # with the total
    rollup = {r["correlation_id"]: r for r in L.trace_rollup(log.ops()).collect()}
    assert rollup[str(bad.runId)]["failures"] == 1 and rollup[str(good.runId)]["steps"] == len(batches) + 1


def test_drained_records_leave_the_log(spark):
    log = OperationLog(spark, "run")
    for _ in range(3):
        with log.operation("step"):
            pass
    assert log.drain().count() == 3 and log.ops().count() == 0
    with log.operation("step"):
        pass
    assert [r["op_id"] for r in log.ops().collect()] == [3]
