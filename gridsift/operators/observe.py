"""Operation records of Spark actions and streams: what ran, how long, how it ended."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

OPS_SCHEMA = (
    "op_id bigint, operation_name string, correlation_id string, start_ts timestamp, duration_ms double, "
    "success boolean, error_type string, metadata map<string,string>"
)


class OperationLog:
    """Collects one record per operation of this run; ``ops`` is the frame to analyse.

    Records are few (one per action, not per row).  Measures of the data come from
    ``observed``, which counts rows while they pass, without another job.
    """

    def __init__(self, spark: SparkSession, correlation_id: str):
        self.spark = spark
        self.correlation_id = correlation_id
        self.records: list[tuple] = []
        self.made = 0
        self.lock = Lock()

    @contextmanager
    def operation(self, name: str) -> Iterator[dict[str, str]]:
        """Time a block; the yielded dict becomes the record's metadata."""
        metadata: dict[str, str] = {}
        start, clock, problem = datetime.now(timezone.utc), time.perf_counter(), None
        try:
            yield metadata
        except Exception as error:
            problem = type(error).__name__
            raise
        finally:
            lasted = (time.perf_counter() - clock) * 1000
            self.record(name, self.correlation_id, start, lasted, problem, metadata)

    def record(self, name: str, correlation_id: str, start: datetime, lasted_ms: float, problem: str | None, metadata: dict) -> None:
        """Add one record; ``problem`` is the type of the error that ended it."""
        with self.lock:
            told = {key: str(value) for key, value in metadata.items()}
            self.records.append((self.made, name, correlation_id, start, float(lasted_ms), problem is None, problem, told))
            self.made += 1

    def observed(
        self, name: str, df: DataFrame, action: Callable[[DataFrame], object], **measures: Column
    ) -> object:
        """Run an action and record the measures Spark took on the way."""
        seen = Observation(name)
        measures = measures or {"rows": F.count(F.lit(1))}
        with self.operation(name) as metadata:
            result = action(df.observe(seen, *[m.alias(k) for k, m in measures.items()]))
            metadata.update(seen.get)
        return result

    @contextmanager
    def streams(self) -> Iterator[StreamRecords]:
        """Record every batch of the streams that run within the block, and how each stream ended."""
        listener = StreamRecords(self)
        self.spark.streams.addListener(listener)
        try:
            yield listener
        finally:
            self.spark.streams.removeListener(listener)

    def ops(self) -> DataFrame:
        with self.lock:
            return self.spark.createDataFrame(list(self.records), OPS_SCHEMA)

    def drain(self) -> DataFrame:
        """The records so far, which leave the log: for runs without end, whose records go to the event log in turns."""
        with self.lock:
            gone, self.records = self.records, []
        return self.spark.createDataFrame(gone, OPS_SCHEMA)


class StreamRecords(StreamingQueryListener):
    """Turns the progress of streams into operation records.

    A batch is an operation ``stream_batch`` of its stream (correlation id: the run's id) with
    rows read, state rows and bytes, and the phases that took time.  The end of a run
    is an operation ``stream_run`` over its whole time, failed if an error ended it.
    Triggers that found nothing give no record.
    """

    def __init__(self, log: OperationLog):
        self.log = log
        self.started: dict[str, tuple[datetime, str]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.started[str(event.runId)] = (_moment(event.timestamp), event.name or str(event.id))

    def onQueryProgress(self, event) -> None:
        told = event.progress
        state = list(told.stateOperators)
        metadata = {
            "stream": told.name or str(told.id),
            "batch_id": told.batchId,
            "rows": told.numInputRows,
            "state_rows": sum(s.numRowsTotal for s in state),
            "state_bytes": sum(s.memoryUsedBytes for s in state),
            "late_rows": sum(s.numRowsDroppedByWatermark for s in state),
        } | {f"{phase}_ms": ms for phase, ms in told.durationMs.items()}
        lasted = told.durationMs.get("triggerExecution", told.batchDuration)
        self.log.record("stream_batch", str(told.runId), _moment(told.timestamp), lasted, None, metadata)

    def onQueryIdle(self, event) -> None:
        """Nothing arrived."""

    def onQueryTerminated(self, event) -> None:
        now = datetime.now(timezone.utc)
        start, name = self.started.pop(str(event.runId), (now, str(event.id)))
        problem = None
        if event.exception:
            # The class of the error in front of its message; Spark gives its own error class where it has one.
            found = re.search(r"([A-Za-z]+(?:Error|Exception))\b", event.exception)
            problem = event.errorClassOnException or (found[1] if found else "Exception")
        self.log.record(
            "stream_run", str(event.runId), start, (now - start).total_seconds() * 1000, problem,
            {"stream": name} | ({"error": event.exception} if event.exception else {}),
        )
        self.ended.add(str(event.runId))


def _moment(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))
