from pyspark.sql import functions as F

from gridsift.operators.confidence import confidence
from gridsift.session import materialize
from gridsift.settings import WatchSettings
from gridsift.sources.workbook import (
    list_sheets, parse_sheets, parse_workbooks, read_workbooks, workbook_errors, workbook_grid, workbook_sheets,
)
from tests import xlsx


def _read(spark, folder):
    return materialize(read_workbooks(spark, WatchSettings(folders=(str(folder),))))


def test_cells_of_all_kinds(spark, tmp_path):
    xlsx.write(tmp_path / "a.xlsx", {
        "Kinds": {
            (1, 0): "text", (1, 1): ("n", "5.0"), (1, 2): ("n", "0.1"), (1, 3): ("b", "1"), (1, 4): ("e", "#N/A"),
            (3, 0): ("date", "45306"), (3, 1): ("date", "45306.4375"), (3, 2): ("custom", "2.5"),
            (3, 3): ("inline", "rich <b>"), (3, 27): ("formula", "f"), (5, 0): "NA", (4, 1): ("date", "0.5"),
        },
    })
    records = _read(spark, tmp_path)
    rows = workbook_grid(records).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in rows] == [0, 1, 2, 3, 4]
    assert all(len(r["cells"]) == 28 for r in rows)
    assert rows[0]["filled"] == 0 and rows[2]["filled"] == 0
    assert rows[1]["cells"][:5] == ["text", "5", "0.1", "True", None]
    assert rows[3]["cells"][:4] == ["2024-01-15 00:00:00", "2024-01-15 10:30:00", "2.5", "rich <b>"]
    assert rows[3]["cells"][27] == "f" and rows[4]["cells"][1] == "12:00:00"
    sheet = workbook_sheets(records).first()
    assert (sheet["max_row"], sheet["max_column"], sheet["sheet_state"]) == (5, 28, "visible")


def test_broken_sheets_and_files_do_not_stop_the_rest(spark, tmp_path):
    good = [["ID", "Name", "Amount"]] + [[("n", i), f"n{i}", ("n", i * 10)] for i in range(1, 12)]
    short = good[:3]
    xlsx.write(
        tmp_path / "book.xlsx",
        {"Good": xlsx.table(good), "Bad": xlsx.table(good), "Empty": {}, "Short": xlsx.table(short)},
        states={"Short": "hidden"}, broken=("Bad",),
    )
    (tmp_path / "fake.xlsx").write_text("not a workbook")
    (tmp_path / "skipped.txt").write_text("x")
    records = _read(spark, tmp_path)
    errors = {(e["source_path"].rsplit("/", 1)[1], e["sheet_name"]) for e in workbook_errors(records).collect()}
    assert errors == {("book.xlsx", "Bad"), ("fake.xlsx", None)}
    sheets = workbook_sheets(records)
    assert {s["sheet_name"]: s["sheet_state"] for s in sheets.collect()} == {
        "Good": "visible", "Empty": "visible", "Short": "hidden"
    }
    scores = {s["table_id"].split("#")[1]: s for s in confidence(workbook_grid(records), listed=sheets).collect()}
    assert set(scores) == {"Good", "Empty", "Short"}
    assert scores["Good"]["accepted"] and scores["Good"]["rows"] == 12
    assert scores["Empty"]["reasons"] == ["Worksheet is empty"]
    assert scores["Short"]["reasons"] == ["Too few rows: 3 < 5"]


def test_size_limit_applies_before_reading(spark, tmp_path):
    xlsx.write(tmp_path / "a.xlsx", {"S": xlsx.table([["a"]])})
    watch = WatchSettings(folders=(str(tmp_path),), max_file_mb=0.0001)
    (record,) = read_workbooks(spark, watch).collect()
    assert record["kind"] == "error" and record["error"].startswith("File too large: 0.0MB > ") and record["source_path"].endswith("a.xlsx")


def test_every_sheet_has_a_task(spark, tmp_path):
    rows = [["ID", "Name"]] + [[("n", i), f"n{i}"] for i in range(4)]
    xlsx.write(tmp_path / "many.xlsx", {f"S{i:02}": xlsx.table(rows) for i in range(20)})
    listed = list_sheets(spark.createDataFrame([(f"file:{tmp_path}/many.xlsx",)], "path string"))
    assert sorted(r["sheet_index"] for r in listed.collect()) == list(range(20))
    records = parse_sheets(listed).withColumn("task", F.spark_partition_id())
    sheets = records.groupBy("sheet_name").agg(F.collect_set("task").alias("tasks"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sheets) == 20 and all(len(r["tasks"]) == 1 and r["n"] == 6 for r in sheets)
    assert len({r["tasks"][0] for r in sheets}) == 20


def test_both_ways_of_reading_agree(spark, tmp_path):
    rows = [["ID", "Name"]] + [[("n", i), f"n{i}"] for i in range(4)]
    for name in ("a b.xlsx", "ü%20.xlsx"):
        xlsx.write(tmp_path / name, {"One": xlsx.table(rows), "Bad": xlsx.table(rows), "two": xlsx.table(rows[:2])}, broken=("Bad",))
    (tmp_path / "fake.xlsx").write_text("not a workbook")
    content = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    columns = ["kind", "source_path", "sheet_index", "sheet_name", "row_idx", "cells", "error"]
    plain = parse_workbooks(content).select(columns).collect()
    placed = _read(spark, tmp_path).select(columns).collect()
    assert sorted(map(str, placed)) == sorted(map(str, plain)) and len(plain) > 15
    wanted = read_workbooks(spark, WatchSettings(folders=(str(tmp_path),)), names=["T*"])
    assert {r["sheet_name"] for r in wanted.collect()} == {"two", None}


def test_a_folder_without_workbooks(spark, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    assert _read(spark, tmp_path).count() == 0
