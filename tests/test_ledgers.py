"""The state operators of the ledgers, a path at a time, without a stream."""

import pyarrow as pa
from pyspark.sql import Row

from gridsift.settings import RetrySettings
from gridsift.streaming import ledgers as Z


class _Store:
    """One path's state and timers, with a count of what is written."""

    def __init__(self):
        self.value, self.writes, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_path_costs_rows_and_writes_only_for_what_it_has():
    store, retries = _Store(), Z._Retries(RetrySettings(max_attempts=3, delay=10, backoff_factor=2), 0)
    retries.init(store)
    outcome = Row("ts", "id", "success")
    # Successes of a path that has not failed leave nothing to keep.
    assert list(retries.handleInputRows(("a",), iter([outcome(5, 0, 1), outcome(6, 1, 1)]), None)) == [] and store.writes == 0
    told = list(retries.handleInputRows(("a",), iter([outcome(9, 4, 0), outcome(7, 2, 0), outcome(8, 3, 1)]), None))
    assert [(r["kind"], r["ts_us"], r["event_id"], r["attempt"]) for r in told] == [("failed", [7, 9], [2, 4], [1, 1])]
    assert store.value[0] == 1 and len(store.timers) == 1 and store.writes == 1
    many = [outcome(100 + i, 10 + i, 0) for i in range(2 * Z.HELD + 1)]
    told = list(retries.handleInputRows(("a",), iter(many), None))
    assert len(told) == 3 and [n for r in told for n in r["attempt"]] == list(range(2, 2 * Z.HELD + 3)) and store.timers == []


def test_changes_of_a_path_are_held_by_rising_values():
    store, changes = _Store(), Z._Changes(1, 0)
    changes.init(store)
    event = Row("o0", "value", "at", "row")
    rows = [event(o, v, o or 0, {"id": i}) for i, (o, v) in enumerate([(3, 5.0), (1, None), (2, 4.0), (4, 5.0), (5, None), (None, 9.0)])]
    assert [r["row"]["id"] for r in changes.handleInputRows(("a",), iter(rows[:5]), None)] == [1, 2, 0] and store.value == (5.0, -1)
    assert list(changes.handleInputRows(("a",), iter(rows[:5]), None)) == [] and store.writes == 1
    assert [r["row"]["id"] for r in changes.handleInputRows(("a",), iter(rows), None)] == [5]
    falling = [event(i, -float(i), i, {"id": i}) for i in range(3 * Z.HELD)]
    assert [r["row"]["id"] for r in Z._Changes.handleInputRows(_fresh(), ("b",), iter(falling), None)] == [0]


def _fresh():
    changes = Z._Changes(1, 0)
    changes.init(_Store())
    return changes


def test_rows_are_thinned_across_the_batches_of_a_task():
    one = pa.RecordBatch.from_pydict({"path": ["a", "b"], "o0": [1, 2], "value": [5.0, 1.0], "id": [0, 1]})
    two = pa.RecordBatch.from_pydict({"path": ["a", "a", "b"], "o0": [3, 4, None], "value": [4.0, 6.0, None], "id": [2, 3, 4]})
    kept = [i for batch in Z._thinned(1)(iter([one, one.slice(0, 0), two])) for i in batch.column("id").to_pylist()]
    assert kept == [0, 1, 3, 4]
