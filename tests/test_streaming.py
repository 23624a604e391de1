import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridsift.operators.ledger import debounce
from gridsift.settings import WatchSettings
from gridsift.sources.workbook import parse_workbooks, workbook_grid
from gridsift.streaming import bursts as B
from gridsift.streaming import files as S
from tests import xlsx

T0 = datetime(2024, 1, 1)
SHEET = [["ID", "Name", "Amount"]] + [[("n", i), f"n{i}", ("n", i * 10)] for i in range(1, 12)]


def _files(spark, folder):
    out = []
    for name in sorted(os.listdir(folder)):
        out.append(name)
    return out


def test_workbooks_are_judged_delivered_and_archived(spark, tmp_path):
    inbox, archive = tmp_path / "in", tmp_path / "archive"
    inbox.mkdir()
    watch = WatchSettings(folders=(str(inbox),))

    def run():
        stream = S.stream_files(spark, watch, archive=str(archive))
        work = S.judge_batches(
            lambda batch: workbook_grid(parse_workbooks(batch)), str(tmp_path / "scores"), str(tmp_path / "out")
        )
        S.run_available(S.each_batch(stream, str(tmp_path / "state"), work))
        return spark.read.option("basePath", str(tmp_path / "scores")).parquet(str(tmp_path / "scores"))

    xlsx.write(inbox / "one.XLSX", {"Data": xlsx.table(SHEET), "Tiny": xlsx.table(SHEET[:2])})
    (inbox / "note.txt").write_text("x")
    first = run()
    assert {(r["table_id"].split("#")[1], r["accepted"]) for r in first.collect()} == {("Data", True), ("Tiny", False)}
    delivered = next((tmp_path / "out" / "batch_id=0").glob("output_name=one_Data.csv"))
    text = "".join(p.read_text() for p in sorted(delivered.glob("part-*")))
    assert text.splitlines()[:2] == ['"ID","Name","Amount"', '"1","n1","10"']

    xlsx.write(inbox / "two.xlsx", {"More": xlsx.table(SHEET)})
    second = run()
    assert second.count() == 3 and second.where("batch_id = 1").count() == 1
    # A consumed file moves once a later batch has run.
    deadline = time.time() + 20
    while "one.XLSX" in _files(spark, inbox) and time.time() < deadline:
        time.sleep(0.5)
    assert "one.XLSX" not in _files(spark, inbox) and "two.xlsx" in _files(spark, inbox)
    assert any("one.XLSX" in names for _, _, names in os.walk(archive))


def test_only_successful_files_are_archived(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    watch = WatchSettings(folders=(str(inbox),), max_file_mb=1)

    def run():
        work = S.judge_batches(
            lambda batch: workbook_grid(parse_workbooks(batch)), str(tmp_path / "scores"), str(tmp_path / "out"), archive="done"
        )
        S.run_available(S.each_batch(S.stream_files(spark, watch), str(tmp_path / "state"), work))

    xlsx.write(inbox / "good.xlsx", {"Data": xlsx.table(SHEET)})
    (inbox / "broken.xlsx").write_bytes(b"no zip")
    (inbox / "large.xlsx").write_bytes(b"x" * (2 << 20))
    run()
    assert _files(spark, inbox) == ["broken.xlsx", "done", "large.xlsx"] and _files(spark, inbox / "done") == ["good.xlsx"]
    xlsx.write(inbox / "good.xlsx", {"Data": xlsx.table(SHEET[:2])})
    xlsx.write(inbox / "more.xlsx", {"Data": xlsx.table(SHEET)})
    run()
    # A file that was seen before comes in again only as a new file; names taken in the archive get the batch as a stamp.
    assert "more.xlsx" in _files(spark, inbox / "done") and len(_files(spark, tmp_path / "out")) == 2


def test_large_and_broken_files_are_told(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "broken.XLSX").write_bytes(b"no zip")
    (inbox / "large.xlsx").write_bytes(b"x" * (2 << 20))
    (inbox / "note.txt").write_text("x")
    records = []
    stream = S.stream_files(spark, WatchSettings(folders=(str(inbox),), max_file_mb=1))
    S.run_available(S.each_batch(stream, str(tmp_path / "state"), lambda df, i: records.extend(parse_workbooks(df).collect())))
    assert sorted((r["source_path"].rsplit("/", 1)[1], r["kind"], r["error"].split(":")[0]) for r in records) == [
        ("broken.XLSX", "error", "BadZipFile"), ("large.xlsx", "error", "File too large"),
    ]


def test_old_files_can_be_skipped(spark, tmp_path):
    for name, age in (("old.xlsx", 3600), ("new.xlsx", 0)):
        xlsx.write(tmp_path / name, {"S": xlsx.table(SHEET)})
        stamp = time.time() - age
        os.utime(tmp_path / name, (stamp, stamp))
    watch = WatchSettings(folders=(str(tmp_path),), process_existing=False)
    stream = S.stream_files(spark, watch, since=datetime.now() - timedelta(minutes=10))
    seen = []
    state = str(tmp_path / "state")
    S.run_available(S.each_batch(
        stream.select("path"), state, lambda df, i: seen.extend(r["path"].rsplit("/", 1)[1] for r in df.collect())
    ))
    assert seen == ["new.xlsx"]


def _feed(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{number}")
    for name in os.listdir(f"{folder}/part{number}"):
        if name.endswith(".parquet"):
            os.rename(f"{folder}/part{number}/{name}", f"{folder}/{number}.parquet")


def test_debounce_stream_with_watermark_emits_closed_bursts(spark, tmp_path):
    schema = "id int, path string, ts timestamp"
    rows = [(0, "a", T0), (1, "a", T0 + timedelta(seconds=1)), (2, "a", T0 + timedelta(seconds=10)),
            (3, "b", T0 + timedelta(seconds=60))]
    events = spark.createDataFrame(rows, schema)
    batch = {(r["path"], r["id"]) for r in debounce(events, "path", "ts", "id", 2).collect()}
    assert batch == {("a", 1), ("a", 2), ("b", 3)}
    inbox = tmp_path / "in"
    inbox.mkdir()
    _feed(spark, inbox, 0, rows, schema)
    stream = B.debounce_stream(S.stream_rows(spark, str(inbox), schema, glob="*.parquet"), "path", "ts", "id", "2 seconds")
    out = str(tmp_path / "out")
    S.run_available(
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "s"))
    )
    emitted = {(r["path"], r["id"]) for r in spark.read.parquet(out).collect()}
    # The burst still open at the watermark stays in the state for the next run.
    assert emitted == batch - {("b", 3)}


def test_restart_continues_without_loss(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    seen = []

    def run():
        stream = S.stream_rows(spark, str(inbox), "id int", max_files=1, glob="*.parquet")
        S.run_available(S.each_batch(
            stream, str(tmp_path / "state"), lambda df, i: seen.append((i, sorted(r["id"] for r in df.collect())))
        ))

    _feed(spark, inbox, 0, [(1,), (2,)], "id int")
    _feed(spark, inbox, 1, [(3,)], "id int")
    run()
    _feed(spark, inbox, 2, [(4,)], "id int")
    run()
    run()
    assert len(seen) == 3 and sorted(i for _, ids in seen for i in ids) == [1, 2, 3, 4]
