"""Quoted line feeds in delimited files that are split at any place."""

import csv
import io
import random

import pytest

from gridsift.sources.files import scan_delimited
from gridsift.sources.records import ends_inside, quoted_records


def made_up(seed, rows, bare=False):
    rng = random.Random(seed)
    parts = ["a", "b c", ",", "\n", "\r\n", '"', '""', "é", "\n\n", "x" * 30, ""]
    cells = [["".join(rng.choices(parts, k=rng.randrange(4))) for _ in range(3)] for _ in range(rows)]
    out = io.StringIO()
    for row in cells:
        csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerow([*row, "end"])
    text = out.getvalue()
    return text if not bare else text + 'un"quoted,a"b"c,,end\n"open, never closed\nmore\n'


def plain_records(text, delimiter=","):
    """The records of a text, line by line from its start."""
    out, held = [], None
    for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
        inside = ends_inside(line, delimiter, held is not None)
        held = line if held is None else held + "\n" + line
        if not inside:
            out.append(held)
            held = None
    out += [held] if held is not None else []
    return [r.removesuffix("\r") for r in out if r.removesuffix("\r")]


@pytest.fixture
def split_at(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def set_to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield set_to
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [64, 301, 5000, 1 << 27])
def test_records_at_any_block_size(spark, tmp_path, split_at, size):
    texts = {f"{k}.csv": made_up(k, 40 + 60 * k, bare=k == 2) for k in range(3)} | {"empty.csv": "", "one.csv": '"a\n\n\nb"', "many.csv": '"' + "line\n" * 500 + '"\nlast\n'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    split_at(size)
    got = {}
    for r in sorted(quoted_records(spark, str(tmp_path)).collect(), key=lambda r: (r["path"], r["block"], r["line"])):
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append(r["record"])
    assert got == {name: records for name, text in texts.items() if (records := plain_records(text))}


def test_states_of_lines():
    for line, outside, inside in [
        ("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('"a""b"', False, False), ('"a"",b', True, False), ('x,"', True, False), ('"', True, False), ('",","', True, False), ("", False, True),
    ]:
        assert (ends_inside(line, ",", False), ends_inside(line, ",", True)) == (outside, inside), line


@pytest.mark.parametrize("size", [200, 1 << 27])
def test_cells_equal_a_read_by_one_task(spark, tmp_path, split_at, size):
    rng, rows = random.Random(9), []
    for i in range(120):
        rows.append([str(i), rng.choice(["x", "a,b", "two\nlines", 'say "hi"', "a\n\n\nb", "c\r\nd", ""]), rng.choice(["é", "1;2", "\n"]), "z"][: rng.choice([3, 4, 4])])
    with open(tmp_path / "t.csv", "w", newline="") as file:
        csv.writer(file, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    split_at(size)
    grid = scan_delimited(spark, str(tmp_path / "t.csv"), multi_line=True)
    got = [r["cells"] for r in sorted(grid.collect(), key=lambda r: r["row_idx"])]
    one = spark.read.option("multiLine", True).option("escape", '"').schema("a string, b string, c string, d string").csv(str(tmp_path / "t.csv")).collect()
    want = [[None if c in ("", None) else c for c in (r["a"], r["b"], r["c"], r["d"])] for r in one]
    assert got == want == [[c or None for c in [*r, None][:4]] for r in rows]
