"""Change and retry ledgers in keyed state: what a batch costs does not grow with the run.

Both keep one small value per path in the state store (RocksDB) and use event-time timers:
the change ledger to forget paths that have been quiet for long, the retry ledger to
say when a failure is due again.  A batch that is replayed starts from the state before
it, so results are the same.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridsift.session import ship_package
from gridsift.settings import RetrySettings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Rows of a path that are held before they are looked through, or told at once.
HELD = 10_000


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Streams started in this session from now on keep their state in RocksDB, as timers ask for.

    Streams that go on from a checkpoint keep the store they have.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ship_package(spark)


def _number(column: Column, kind: T.DataType) -> Column:
    """Times as microseconds, other numbers as they are."""
    return F.unix_micros(column.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else column


def rising(paths: np.ndarray, order: Sequence[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Places, in order, of the rows whose value exceeds all earlier ones of their path (NaN: no value)."""
    place = np.lexsort((*reversed(order), paths))
    rows = pd.DataFrame({"path": paths[place], "value": values[place]})
    before = rows.groupby("path")["value"].cummax().groupby(rows["path"]).ffill().groupby(rows["path"]).shift()
    return place[(before.isna() | (rows["value"] > before)).to_numpy()]


def _thinned(orders: int, most_bytes: int = 32 << 20) -> Callable:
    """Leaves out what an earlier row of the same stretch of rows already tops; it could never be a change."""

    def thin(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        code = pd.factorize(rows.column(0).to_pandas(), use_na_sentinel=False)[0]
        order = [rows.column(1 + k).fill_null(np.iinfo(np.int64).min).to_numpy() for k in range(orders)]
        values = rows.column(1 + orders).cast(pa.float64()).to_numpy()
        yield from rows.take(pa.array(np.sort(rising(code, order, values)))).to_batches(max_chunksize=HELD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= most_bytes:
                yield from thin(held)
                held, size = [], 0
        if held:
            yield from thin(held)

    return run


def _risen(rows: list[Row], orders: int) -> list[Row]:
    """The rows of one path, in order, whose value exceeds all earlier ones (null: no value)."""
    low, kept, top = np.iinfo(np.int64).min, [], None
    for row in sorted(rows, key=lambda r: [low if (o := r[f"o{k}"]) is None else o for k in range(orders)]):
        if top is None or (row["value"] is not None and row["value"] > top):
            kept.append(row)
            top = row["value"]
    return kept


class _Changes(StatefulProcessor):
    """State of a path: its newest value, forgotten ``keep_ms`` after its newest event (0: never)."""

    def __init__(self, orders: int, keep_ms: int):
        self.orders, self.keep_ms = orders, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "value double, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        value, timer = known = self.newest.get() or (None, -1)
        held, most, last = [], HELD, -1
        for row in rows:
            last = max(last, row["at"])
            if value is None or (row["value"] is not None and row["value"] > value):
                held.append(row)
            if len(held) >= most:
                held = _risen(held, self.orders)
                most = 2 * len(held) + HELD
        held = _risen(held, self.orders)
        if held and held[-1]["value"] is not None:
            value = held[-1]["value"]
        if self.keep_ms and last // 1000 + self.keep_ms > timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = last // 1000 + self.keep_ms
            self.handle.registerTimer(timer)
        if (value, timer) != known:
            self.newest.update((value, timer))
        for row in held:
            yield Row(row=row["row"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        return iter(())


def changed_events(events: DataFrame, path: str, order: Sequence[str], mtime: str, ts: str, late_seconds: float = 1.0, keep_days: int = 0) -> DataFrame:
    """The streaming form of ``changed_only``: events whose ``mtime`` exceeds every earlier one of their path.

    ``order`` (whole numbers and times) puts the events of a batch in order; batches follow
    each other, so the result is that of all events in order as long as batches are.
    ``mtime`` is a time or a number.  ``ts`` is the event time; events older than the newest
    by more than ``late_seconds`` are dropped, as are those without a path or a time.  With
    ``keep_days`` a path without events for so long is forgotten, and its next event counts as
    its first.  Each task first drops what its own rows already top, so a busy path moves
    and holds only rising values.
    """
    keep_state_in_rocksdb(events.sparkSession)
    kinds = {f.name: f.dataType for f in events.schema.fields}
    # No underscores in front of these names: rows of state come as named tuples.
    rows = events.where(F.col(path).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(path).alias("path"), *[_number(F.col(c), kinds[c]).cast("long").alias(f"o{k}") for k, c in enumerate(order)],
        F.nanvl(_number(F.col(mtime), kinds[mtime]).cast("double"), F.lit(None)).alias("value"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.struct(*events.columns).alias("row"),
    )
    few = rows.mapInArrow(_thinned(len(order)), rows.schema)
    few = few.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", f"{late_seconds} seconds")
    schema = T.StructType([T.StructField("row", events.schema)])
    found = few.groupBy("path").transformWithState(_Changes(len(order), keep_days * DAY_MS), schema, "append", "eventTime")
    return found.select("row.*")


#: Rows of one path and kind, side by side: a path tells all it has in few rows.
RETRY_LISTS = "path string, kind string, ts_us array<long>, event_id array<long>, attempt array<int>, due_us array<long>"


def waits_us(attempts: np.ndarray, retry: RetrySettings) -> np.ndarray:
    """Microseconds to wait after failures of these numbers, as ``backoff`` says."""
    grown = retry.delay * np.power(float(retry.backoff_factor), np.maximum(attempts - 1, 0))
    return (np.where(attempts <= 1, retry.delay, np.minimum(grown, retry.max_delay)) * 1_000_000).astype(np.int64)


class _Retries(StatefulProcessor):
    """State of a path: how often it failed since its last success, and the timer of its next try."""

    def __init__(self, retry: RetrySettings, late_us: int):
        self.retry, self.late_us = retry, late_us

    def _now(self, timerValues, at_least: int) -> int:
        """The newest event time the watermark tells of, in microseconds."""
        return max(at_least, timerValues.getCurrentWatermarkInMs() * 1000 + self.late_us)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failed = handle.getValueState("failed", "attempt int, timer long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        at, ids, said = array("q"), array("q"), array("b")
        for row in rows:
            at.append(row["ts"])
            ids.append(row["id"])
            said.append(row["success"])
        at, ids, outcome = np.frombuffer(at, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(said, np.int8)
        place = np.lexsort((ids, at))
        at, ids, outcome = at[place], ids[place], outcome[place]
        attempt, timer, due = known = self.failed.get() or (0, -1, -1)
        # Failures count on from the state up to the first success, and from 0 after each success.
        now, failures = outcome == 0, np.cumsum(outcome == 0)
        number = (failures - np.maximum.accumulate(np.where(outcome == 1, failures, -attempt)))[now]
        ts, ids = at[now], ids[now]
        dues = ts + waits_us(number, self.retry)
        for n in range(0, len(ts), HELD):
            some = slice(n, n + HELD)
            yield Row(path=key[0], kind="failed", ts_us=ts[some].tolist(), event_id=ids[some].tolist(), attempt=number[some].tolist(), due_us=dues[some].tolist())
        if (outcome >= 0).any():
            last = outcome[outcome >= 0][-1]
            attempt, due = (0, -1) if last == 1 else (int(number[-1]), int(dues[-1]))
            # Rounded up: a timer has milliseconds.
            wanted = -(-due // 1000) if 0 < attempt < self.retry.max_attempts else -1
            if timer >= 0 and timer != wanted:
                self.handle.deleteTimer(timer)
            if wanted >= 0 and timer != wanted:
                self.handle.registerTimer(wanted)
            if (attempt, wanted, due) != known:
                self.failed.update((attempt, wanted, due))
        elif attempt < self.retry.max_attempts and (outcome < 0).any():
            # A new input: tried at once, and a waiting failure is not tried twice.
            if timer >= 0:
                self.handle.deleteTimer(timer)
                self.failed.update((attempt, -1, due))
            yield self._asked(key[0], self._now(timerValues, int(at[-1])), attempt, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        attempt, timer, due = self.failed.get() or (0, -1, -1)
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            self.failed.update((attempt, -1, due))
            yield self._asked(key[0], self._now(timerValues, due), attempt, due)

    def _asked(self, path: str, ts: int, attempt: int, due: int | None) -> Row:
        return Row(path=path, kind="try", ts_us=[ts], event_id=[None], attempt=[attempt], due_us=[due])


def retry_events(outcomes: DataFrame, path: str, ts: str, event_id: str, success: str, retry: RetrySettings = RetrySettings(), late_seconds: float = 1.0) -> DataFrame:
    """The streaming form of ``attempts``, with timers: ``path, kind, ts_us, event_id, attempt, exhausted, due_us``.

    A row whose ``success`` is false is a failure and gives a row of kind ``failed`` with its
    number since the last success, and when the next try is due; a success starts over.  A row
    without ``success`` is a new input.  Rows of kind ``try`` name the paths to try: new inputs,
    and failures whose time has come by the event time of the stream, whether or not the path
    itself has rows.  Paths that are exhausted are tried no more until they succeed.  Rows
    without a path only move the clock (``heartbeat``); rows older than the newest by more
    than ``late_seconds`` are dropped.  Within a batch outcomes come before new inputs of a path.
    A try is dated with the newest event time, so that its outcome is not late.
    """
    keep_state_in_rocksdb(outcomes.sparkSession)
    # Outcomes as 1, 0 and, of new inputs, -1.
    rows = outcomes.where(F.col(ts).isNotNull()).select(
        F.col(path).cast("string").alias("path"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"),
        F.coalesce(F.col(event_id).cast("long"), F.lit(0)).alias("id"), F.coalesce(F.col(success).cast("int"), F.lit(-1)).alias("success"),
        F.col(ts).cast("timestamp").alias("event_time"),
    )
    timed = rows.withWatermark("event_time", f"{late_seconds} seconds")
    found = timed.groupBy("path").transformWithState(_Retries(retry, int(late_seconds * 1_000_000)), RETRY_LISTS, "append", "eventTime")
    told = found.select("path", "kind", F.inline(F.arrays_zip("ts_us", "event_id", "attempt", "due_us")))
    spent = F.col("attempt") >= retry.max_attempts
    return told.select("path", "kind", "ts_us", "event_id", "attempt", spent.alias("exhausted"), F.when(~spent, F.col("due_us")).alias("due_us"))


OUTCOME_SCHEMA = "path string, ts timestamp, event_id bigint, success boolean"


def outcome_feed(spark: SparkSession, folder: str) -> DataFrame:
    """What ``trying`` has written, as a stream; files that were read are deleted.

    The folder must exist.
    """
    return spark.readStream.schema(OUTCOME_SCHEMA).option("cleanSource", "delete").option("recursiveFileLookup", True).parquet(folder)


def trying(folder: str, process: Callable[[DataFrame, int], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Callback for the rows of ``retry_events``: tries what is to be tried and hands the outcomes back.

    ``process`` gets ``path, ts`` and returns ``path, success``; outcomes carry the time of
    the try.  Written under ``folder``, they come in again through ``outcome_feed``, which
    is put in union with the inputs (``success`` null) of the same ``retry_events``.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        tries = batch.where("kind = 'try'").groupBy("path").agg(F.timestamp_micros(F.max("ts_us")).alias("ts")).persist()
        try:
            if not tries.isEmpty():
                outcome = process(tries, batch_id).select("path", "success")
                rows = outcome.join(tries, "path").select("path", "ts", F.lit(batch_id).cast("long").alias("event_id"), "success")
                rows.write.mode("overwrite").parquet(f"{folder}/batch_{batch_id}")
        finally:
            tries.unpersist()

    return work
