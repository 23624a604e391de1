import random

import pytest
from pyspark.sql import functions as F

from gridsift.plans import join_small, next_value, number_since, number_within, running_max_before


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows share one key; another key is null."""
    # Small partitions would be merged into one; keep them apart to cross the cuts.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.66 else rng.choice([None, "a", "b", "c"])
        rows.append((key, rng.randint(0, 400), i, rng.randint(0, 10**6)))
    yield rows, spark.createDataFrame(rows, "k string, at int, id int, v int").repartition(7)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _grouped(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_number_within(skewed):
    rows, df = skewed
    got = {r["id"]: r["n"] for r in number_within(df, ["k"], ["at", "id"], "n").collect()}
    want = {r[2]: i for g in _grouped(rows).values() for i, r in enumerate(g, 1)}
    assert got == want


def test_number_without_keys(skewed):
    rows, df = skewed
    got = {r["id"]: r["n"] for r in number_within(df, [], ["at", "id"], "n").collect()}
    assert got == {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}


def test_running_max_before(skewed):
    rows, df = skewed
    got = {r["id"]: r["m"] for r in running_max_before(df, ["k"], ["at", "id"], "v", "m").collect()}
    want = {}
    for group in _grouped(rows).values():
        largest = None
        for row in group:
            want[row[2]] = largest
            largest = row[3] if largest is None else max(largest, row[3])
    assert got == want


def test_next_value(skewed):
    rows, df = skewed
    got = {r["id"]: r["n"] for r in next_value(df, ["k"], ["at", "id"], "v", "n").collect()}
    want = {}
    for group in _grouped(rows).values():
        for row, later in zip(group, [*group[1:], None]):
            want[row[2]] = later and later[3]
    assert got == want


def test_hot_group_is_cut_into_parts(skewed, spark):
    _, df = skewed
    from gridsift.plans.ordered import _Parts

    parts = _Parts(df, ["k"], ["at", "id"])
    sizes = [r["count"] for r in parts.rows.where("k = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 3000 / 5
    # All rows of divided groups feed the summary.
    assert parts.divided.where("k = 'hot'").count() == sum(sizes)


def test_number_since(skewed):
    rows, df = skewed
    marked = df.withColumn("stop", F.col("v") % 97 == 0)
    got = {r["id"]: r["n"] for r in number_since(marked, ["k"], ["at", "id"], "stop", "n").collect()}
    want = {}
    for group in _grouped(rows).values():
        n = 0
        for row in group:
            n = 0 if row[3] % 97 == 0 else n + 1
            want[row[2]] = n
    assert got == want and max(got.values()) > 150


@pytest.mark.parametrize("rows", [0, 1])
def test_ordered_plans_of_few_rows(spark, rows):
    df = spark.range(rows).select(F.lit(None).cast("string").alias("k"), "id", F.lit(False).alias("stop"))
    for made in (
        number_within(df, ["k"], ["id"], "n"), number_since(df, ["k"], ["id"], "stop", "n"),
        running_max_before(df, ["k"], ["id"], "id", "n"), next_value(df, ["k"], ["id"], "id", "n"),
    ):
        assert made.count() == rows


def test_rows_move_once_and_are_not_kept(spark, tmp_path):
    """Every exchange but one is of rows that an aggregate has reduced, and the rows come straight from the files."""
    spark.range(1000).select((F.col("id") % 5).alias("k"), "id", F.repeat(F.lit("x"), 50).alias("wide"), (F.col("id") % 7 == 0).alias("stop")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for made in (
        number_within(df, ["k"], ["id"], "n"), number_since(df, ["k"], ["id"], "stop", "n"),
        running_max_before(df, ["k"], ["id"], "id", "n"), next_value(df, ["k"], ["id"], "id", "n"),
    ):
        lines = made._jdf.queryExecution().executedPlan().toString().splitlines()
        below = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        assert sum("Aggregate" not in line for line in below) == 1
        wide = [line for line in lines if "FileScan" in line and "wide:string" in line.split("ReadSchema")[1]]
        assert len(wide) == 1 and not any("Scan ExistingRDD" in line and "wide" in line for line in lines)


@pytest.mark.parametrize("limit", [0, 10**9])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_small_both_ways(skewed, spark, how, limit):
    _, df = skewed
    small = spark.createDataFrame([("hot", 1), ("a", 2), ("zzz", 3)], "k string, w int")
    columns = ["id"] if how.startswith("left_") else ["id", "w"]
    want = df.join(small, "k", how).select(columns)
    got = join_small(df, small, ["k"], how, limit).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_beyond_the_limit_broadcasts_nothing(spark, tmp_path, how):
    """The files of the small side are tiny, and so is Spark's estimate of it."""
    spark.range(1000).select("id", F.lit("x").alias("w")).write.parquet(str(tmp_path / "small"))
    joined = join_small(spark.range(3000), spark.read.parquet(str(tmp_path / "small")), ["id"], how, 0)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == {"inner": 1000, "left": 3000, "left_semi": 1000, "left_anti": 2000}[how]


def test_sample_is_reproducible(spark):
    from gridsift.operators.grid import sample_rows

    big = spark.range(5000)
    first = sample_rows(big, "id").count()
    assert first == sample_rows(big.repartition(5), "id").count() and 800 < first < 1200
    assert 150 < sample_rows(spark.range(1000), "id").count() < 250
    nulls = spark.sql("SELECT cast(null AS bigint) AS id")
    assert sample_rows(nulls, "id", 1.0).count() == 1
    assert big.select(F.max("id")).first()[0] == 4999


def test_ordered_plans_stay_small_with_many_parts(spark):
    """The place among the cuts is said once: the plan does not grow with the number of parts."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        df = spark.range(4000, numPartitions=2).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 7 == 0).alias("stop"))
        for made in (
            number_within(df, ["k"], ["id"], "n"), number_since(df, ["k"], ["id"], "stop", "n"),
            running_max_before(df, ["k"], ["id"], "id", "n"), next_value(df, ["k"], ["id"], "id", "n"),
        ):
            assert len(made._jdf.queryExecution().optimizedPlan().toString()) < 20_000
        got = {(r["k"], r["id"]): r["n"] for r in number_within(df, ["k"], ["id"], "n").collect()}
        assert got == {(i % 3, i): i // 3 + 1 for i in range(4000)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
