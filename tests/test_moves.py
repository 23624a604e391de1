from pathlib import Path

import pytest

from gridsift.sources import moves
from gridsift.sources.writers import archive_inputs


@pytest.fixture
def inbox(tmp_path):
    (tmp_path / "in" / "archive").mkdir(parents=True)
    for i in range(10):
        (tmp_path / "in" / f"f {i}.csv").write_text(str(i))
    return tmp_path / "in"


def _outcomes(spark, inbox):
    rows = [(f"file:{inbox}/f {i}.csv", i != 7) for i in range(10)]
    return spark.createDataFrame(rows, "source string, success boolean")


def _names(folder: Path):
    return sorted(p.name for p in folder.iterdir() if p.is_file() and not p.name.startswith("."))


def test_tasks_move_by_plan(spark, inbox):
    (inbox / "archive" / "f 3.csv").write_text("older")
    done = archive_inputs(spark, _outcomes(spark, inbox), "S").collect()
    assert {r["state"] for r in done} == {"moved"} and len(done) == 9
    assert _names(inbox) == ["f 7.csv"]
    kept = {n: (inbox / "archive" / n).read_text() for n in _names(inbox / "archive")}
    assert kept == {f"f {i}.csv": str(i) for i in range(10) if i not in (3, 7)} | {"f 3.csv": "older", "f 3_S.csv": "3"}


def test_a_broken_run_is_completed(spark, inbox, tmp_path, monkeypatch):
    """The run ends after the plan and half of the moves; the next one makes the others by the same plan."""
    manifest = str(tmp_path / "moves" / "5")
    with monkeypatch.context() as patch:
        patch.setattr("gridsift.sources.writers.move_files", lambda plan: plan)
        plan = archive_inputs(spark, _outcomes(spark, inbox), "S", manifest=manifest).collect()
    assert len(_names(inbox)) == 10
    for row in plan[::2]:
        assert moves.move_one(row["source"], row["archive_path"]) == "moved"
    states = [r["state"] for r in archive_inputs(spark, None, "T", manifest=manifest).collect()]
    assert sorted(states) == ["done"] * 5 + ["moved"] * 4
    assert _names(inbox) == ["f 7.csv"] and _names(inbox / "archive") == [f"f {i}.csv" for i in range(10) if i != 7]
    again = archive_inputs(spark, None, "T", manifest=manifest).collect()
    assert {r["state"] for r in again} == {"done"}


def test_files_without_place_and_lost_files(spark, tmp_path):
    rows = [(f"file:{tmp_path}/none.csv", f"file:{tmp_path}/a/none.csv", None), (f"file:{tmp_path}/x.csv", None, "Too many")]
    got = {r["archive_error"]: r["state"] for r in moves.move_files(spark.createDataFrame(rows, moves.PLAN_SCHEMA)).collect()}
    assert got == {None: "absent", "Too many": None}
    assert moves.move_files(spark.createDataFrame([], moves.PLAN_SCHEMA)).count() == 0
    assert moves.move_one("nowhere://host/x", "nowhere://host/y") == "other"
