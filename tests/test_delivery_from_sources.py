"""Delivery of tables that come from sources: order, what crosses the exchange, what is read, and what is left on disk."""

import time

import pytest
from pyspark.sql import functions as F

from gridsift.functions.numbers import format_number, g6_cells, plain_g6
from gridsift.operators import clean as N
from gridsift.operators import confidence as C
from gridsift.operators import grid as G
from gridsift.settings import OutputSettings
from gridsift.sources import writers as W


@pytest.fixture
def sources(spark, tmp_path):
    """One table of its own source, and a source of several; positions repeat and come in no order, cells and keys are null."""
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    spark.range(600).repartition(3).selectExpr(
        "599 - id + IF(id = 7, 1, 0) AS k", "string(id % 50) || '.50' AS price", "IF(id % 9 = 0, NULL, 'a \"b\", ' || id) AS name",
    ).write.parquet(one)
    spark.range(300).repartition(2).selectExpr(
        "IF(id % 11 = 0, NULL, 'm' || (id % 3)) AS t", "id AS k", "string(id) AS id", "'0' || (1234564 + id) || '.5' AS big",
        "date_format(timestampadd(DAY, id % 300, TIMESTAMP '2024-01-01 10:00:00'), 'MM/dd/yyyy') AS day",
    ).write.parquet(many)
    return [
        G.GridSource(spark.read.parquet(one), "one", "k", columns=("price", "name")),
        G.GridSource(spark.read.parquet(many), F.col("t"), "k", columns=("id", "big", "day")),
    ]


def _names(spark, *tables):
    return spark.createDataFrame([(t, f"{t}.csv") for t in tables], "table_id string, output_name string")


def _files(path):
    return {d.name: "".join(p.read_text() for p in sorted(d.glob("part-*"))) for d in path.glob("output_name=*")}


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [found.apply(i).getName() for i in range(found.size())]
    return {n for n in names if n.startswith("shuffle_")}


@pytest.mark.parametrize("headers", [True, False])
def test_files_of_sources_are_those_of_a_plain_grid(spark, sources, tmp_path, monkeypatch, headers):
    """Many parts, cut by the keys alone: every line is there once, and the files read as the range exchange wrote them."""
    monkeypatch.setattr(W, "LINE_PART_BYTES", 2000)
    known, names, output = C.profile(sources), _names(spark, "one", "m0", "m2"), OutputSettings(include_headers=headers)
    W.write_tables(known, names, str(tmp_path / "a"), output)
    W.write_tables(C.profile(G.corpus_grid(sources)), names, str(tmp_path / "b"), output)
    got, want = _files(tmp_path / "a"), _files(tmp_path / "b")
    assert set(got) == {"output_name=one.csv", "output_name=m0.csv", "output_name=m2.csv"}
    assert len(list((tmp_path / "a" / "output_name=one.csv").glob("part-*"))) > 5
    for name, text in want.items():
        assert sorted(got[name].splitlines()) == sorted(text.splitlines())
    for name in ("output_name=m0.csv", "output_name=m2.csv"):
        assert got[name] == want[name]
    lines = got["output_name=one.csv"].splitlines()
    assert lines[1].startswith('"49.5') and len(lines) == 600 + 1
    plain = sorted(map(tuple, W.delivery_lines(known, names, output).collect()))
    assert plain == sorted(map(tuple, W.delivery_lines(C.profile(G.corpus_grid(sources)), names, output).collect()))


def test_shuffle_files_go_with_the_write(spark, sources, tmp_path):
    """Delivering again and again holds no more shuffle files than one delivery."""
    known, names = C.profile(sources), _names(spark, "one", "m0", "m1")
    exchanged = []
    kept = W.shuffles_freed

    def watched(session):
        exchanged.append(_shuffle_files(spark))
        return kept(session)

    W.shuffles_freed = watched
    try:
        W.write_tables(known, names, str(tmp_path / "out"))
    finally:
        W.shuffles_freed = kept
    for _ in range(50):
        left = _shuffle_files(spark) - exchanged[0]
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_only_wanted_tables_are_read_and_only_text_is_exchanged(spark, sources):
    lines = W._placed_lines(C.profile(sources), _names(spark, "one"), OutputSettings(), None)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "rangepartitioning" not in lines._jdf.queryExecution().executedPlan().toString()
    below = plan.split("RepartitionByExpression")[1].splitlines()[1]
    assert "cells#" not in below and "kinds#" not in below
    none = W._placed_lines(C.profile(sources), _names(spark, "gone"), OutputSettings(), None)
    assert none.count() == 0 and lines.count() == 601


def test_cleaned_rows_of_sources(spark, sources):
    for compat in (None, "g6"):
        got, _ = N.clean_tables(sources, compat=compat)
        want, _ = N.clean_tables(G.corpus_grid(sources), compat=compat)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    cells = {r["row_idx"]: r["cells"] for r in got.where("table_id = 'm0'").collect()}
    assert cells[3 + 1] == ["3", "1.23457e+06", "2024-01-04 00:00:00"]


def test_six_digits_without_python(spark):
    """What the plain rule settles is what C prints; ties, exponents and small fractions are left to the exact one."""
    texts = ["0", "-0", "12.50", "999999.7", "999999.4", "9999996", "-123456.78", "1234567", "100000000", "9.999996", "12345.675", "-7",
             "1.234565", "12345.65", "1234565", "1e300", "0.00001", "0.1234567", "9" * 20, "0.05", "123456", "x", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string").withColumn("c", format_number(F.col("v")))
    whole = g6_cells(F.array("c", "v"), F.array(F.lit("number"), F.lit("text")))
    rows = df.select("c", "v", plain_g6(F.col("c")).alias("plain"), whole.alias("whole")).collect()
    for r in rows:
        want = f"{float(r['c']):g}" if r["c"] else ""
        assert r["whole"] == [want, r["v"]] and r["plain"] in (None, want)
    left = [r["v"] for r in rows if r["plain"] is None]
    assert left == ["1.234565", "12345.65", "1234565", "1e300", "0.00001", "0.1234567", "9" * 20]
