"""Profiles that merge, and ledgers in keyed state, over several batches."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsift.operators import merging as M
from gridsift.operators.confidence import confidence
from gridsift.operators.grid import as_grid
from gridsift.operators.ledger import attempts, changed_only
from gridsift.session import materialize
from gridsift.settings import RetrySettings
from gridsift.streaming import files as S
from gridsift.streaming import ledgers as Z

T0 = datetime(2024, 1, 1)
GRID = "table_id string, row_idx bigint, cells array<string>"


def rows_of(seed=1):
    """Tables of several kinds, rows in random order: late values, kinds that change, blank rows and columns."""
    rng = random.Random(seed)
    rows = [("names", 0, ["ID", "Name", "Amount", "Note", "When"]), ("late", 0, ["key", "value"]), ("mixed", 0, ["Code", "Total"])]
    for i in range(1, 90):
        rows.append(("names", i, [str(i), rng.choice("abcdefg") * 3, str(i / 4), "x" if i == 70 else None, f"2024-01-{i % 28 + 1:02d}"]))
    for i in range(1, 60):
        rows.append(("late", i, [None if i < 50 else f"k{i}", None if i % 3 else str(i)]))
    for i in range(1, 80):
        rows.append(("mixed", i, [str(i) if i < 40 else f"w{i % 9}", str(i) if i % 2 else "n.a."]))
    rows += [("blank", i, [None, None]) for i in range(8)] + [("tiny", 0, ["a", "b"])]
    rng.shuffle(rows)
    return rows


def kept(frames):
    return {name: materialize(df) for name, df in frames.items()}


def scores_of(df):
    return {r["table_id"]: {k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.collect()}


def test_merged_parts_are_judged_as_the_whole(spark):
    parts = 3
    rows = rows_of()
    whole = as_grid(spark.createDataFrame(rows, GRID))
    known = None
    for k in range(parts):
        some = kept(M.part(as_grid(spark.createDataFrame(rows[k::parts], GRID))))
        known = some if known is None else kept(M.merged(known, some))
    assert scores_of(confidence(M.merged_profile(known))) == scores_of(confidence(whole))
    # Column kinds that differ between parts are told; the values of no other column are estimated.
    assert all(r["table_id"] in ("mixed", "names") for r in M.inexact(known).collect())


def test_sketches_alone_are_close(spark):
    rows = rows_of(2)
    known = kept(M.merged(*(kept(M.part(as_grid(spark.createDataFrame(rows[k::2], GRID)), exact=False)) for k in range(2))))
    assert known["keys"].isEmpty()
    near, exact = scores_of(confidence(M.merged_profile(known))), scores_of(confidence(as_grid(spark.createDataFrame(rows, GRID))))
    assert all(abs(near[t]["overall"] - exact[t]["overall"]) < 0.05 for t in exact)


def test_growing_tables_over_batches(spark, tmp_path):
    rows = [(t, i + 1, c) for t, i, c in rows_of(3) if i]
    names = as_grid(spark.createDataFrame([(t, i, c) for t, i, c in rows_of(3) if not i], GRID))
    state, scores = str(tmp_path / "state"), str(tmp_path / "scores")
    work = S.judge_growing(as_grid, state, scores, header=names)
    batch = lambda k: spark.createDataFrame(rows[k::3], GRID)
    for k in (0, 1, 2, 2):  # the last batch is replayed
        work(batch(k), k)
    seen = {r[0] for r in rows}
    whole = as_grid(spark.createDataFrame(rows, GRID)).unionByName(names.where(F.col("table_id").isin(*seen)))
    want = scores_of(confidence(whole))
    assert scores_of(S.last_scores(spark, scores)) == want == scores_of(S.judge_kept(spark, state))
    assert sorted(p.name for p in (tmp_path / "state" / "columns").iterdir() if p.name.startswith("batch")) == ["batch_id=1", "batch_id=2"]


def run_batches(spark, tmp_path, schema, groups, make):
    """Each group of rows in a run of its own of the stream ``make(stream)``; all rows it gave."""
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    for rows in groups:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(schema).parquet(str(inbox))
        writer = make(stream).writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch_id={i}"))
        S.run_available(writer.option("checkpointLocation", str(tmp_path / "state")))
    return spark.read.option("basePath", out).parquet(out).drop("batch_id")


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_changes_over_batches(spark, tmp_path, few_partitions):
    rng = random.Random(5)
    schema = "id long, path string, ts timestamp, mtime timestamp, extra int"
    rows = [
        (i, rng.choice(["a", "a", "a", "b", "c", f"p{i}"]), T0 + timedelta(seconds=i), None if i % 11 == 0 else T0 + timedelta(seconds=rng.randrange(400)), None if i % 2 else i)
        for i in range(120)
    ]
    groups = [rng.sample(g, len(g)) for g in (rows[:50], rows[50:80], rows[80:])]
    got = run_batches(spark, tmp_path, schema, groups, lambda s: Z.changed_events(s, "path", ["ts", "id"], "mtime", "ts"))
    want = changed_only(spark.createDataFrame(rows, schema), "path", ["ts", "id"], "mtime")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_quiet_paths_are_forgotten(spark, tmp_path, few_partitions):
    schema = "id long, path string, ts timestamp, mtime double"
    groups = [[(0, "a", T0, 9.0), (1, None, T0, 1.0)], [(2, "b", T0 + timedelta(days=3), 1.0)], [(3, "a", T0 + timedelta(days=3), 2.0), (4, "b", T0 + timedelta(days=3), 0.5)]]
    got = run_batches(spark, tmp_path, schema, groups, lambda s: Z.changed_events(s, "path", ["ts", "id"], "mtime", "ts", keep_days=2))
    # The state of "a" has gone, so its smaller value counts as its first; that of "b" has not.
    assert sorted(r["id"] for r in got.collect()) == [0, 2, 3]


def test_rising_values():
    order = np.array([2, 1, 3, 4, 5, 6])
    values = np.array([5.0, np.nan, 4.0, 6.0, np.nan, 6.0])
    assert Z.rising(np.zeros(6, np.int64), [order], values).tolist() == [1, 0, 3]
    paths = pd.factorize(pd.Series(["x", "y", "x", "y", "x", "y"]))[0]
    assert sorted(Z.rising(paths, [order], values).tolist()) == [0, 1, 3]


def test_failures_over_batches_are_the_schedule(spark, tmp_path, few_partitions):
    rng = random.Random(6)
    schema = "id long, path string, ts timestamp, ok boolean"
    rows = [(i, rng.choice("aab") if i % 9 else f"p{i}", T0 + timedelta(seconds=i), rng.random() < 0.3) for i in range(90)]
    groups = [rng.sample(g, len(g)) for g in (rows[:40], rows[40:60], rows[60:])]
    retry = RetrySettings(max_attempts=3, delay=2, backoff_factor=3, max_delay=5)
    out = run_batches(spark, tmp_path, schema, groups, lambda s: Z.retry_events(s, "path", "ts", "id", "ok", retry))
    got = {(r["event_id"], r["path"], r["attempt"], r["exhausted"], r["due_us"]) for r in out.where("kind = 'failed'").collect()}
    batch = attempts(spark.createDataFrame(rows, schema), "path", "ts", "id", retry, success="ok")
    want = {(r["id"], r["path"], r["attempt"], r["exhausted"], r["due"]) for r in batch.withColumn("due", F.unix_micros("next_attempt_ts")).collect()}
    assert got == want and {a for _, _, a, _, _ in got} >= {1, 2, 3}


def test_retries_come_due_by_timers_and_outcomes_come_back(spark, tmp_path, few_partitions):
    feed, tried = tmp_path / "feed", []
    feed.mkdir()

    def process(tries, batch_id):
        paths = sorted(r["path"] for r in tries.collect())
        tried.append(paths)
        return tries.withColumn("success", F.col("path") == "good")

    work = Z.trying(str(feed), process)
    schema = "path string, ts timestamp, event_id bigint, success boolean"
    retry = RetrySettings(max_attempts=3, delay=10, backoff_factor=2)

    def run(number, *rows):
        spark.createDataFrame([(p, T0 + timedelta(seconds=s), 0, None) for p, s in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
        inputs = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream = Z.retry_events(inputs.unionByName(Z.outcome_feed(spark, str(feed))), "path", "ts", "event_id", "success", retry, late_seconds=3600)
        S.run_available(stream.writeStream.foreachBatch(work).option("checkpointLocation", str(tmp_path / "state")))

    hour = 3600
    run(0, ("bad", 0), ("good", 0))        # both are tried at once
    run(1, (None, 5))                      # the outcomes come in: bad failed, due 10 seconds after its try
    assert tried == [["bad", "good"]]
    run(2, (None, hour + 60))              # the clock has passed the due time: a timer, no row of bad
    run(3, (None, hour + 70))              # the second failure comes in, due 20 seconds after the due time
    run(4, (None, 2 * hour + 200))
    run(5, (None, 2 * hour + 210))         # the third failure: exhausted
    run(6, (None, 9 * hour), ("bad", 8 * hour), ("new", 8 * hour))
    assert tried == [["bad", "good"], ["bad"], ["bad"], ["new"]]
