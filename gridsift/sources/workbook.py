"""Workbook files (.xlsx) as grid rows.

A zip archive can be entered at any part, so the sheets of a file are read by tasks of
their own: one pass lists the sheets, another reads each of them from its place in the file.
Files are bounded by the size limit, which is applied before any content is read.  Rows
leave the task in batches.  A broken sheet or file becomes an error record, the rest
goes on.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from fnmatch import fnmatchcase
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.functions import match_glob
from gridsift.functions.text import NULL_TOKENS
from gridsift.operators.grid import as_grid
from gridsift.plans import join_small, number_within
from gridsift.session import materialize, ship_package
from gridsift.settings import WatchSettings
from gridsift.sources.files import MEGABYTE, file_name, name_glob, too_large
from gridsift.sources.moves import known, opened

RECORD_SCHEMA = (
    "kind string, source_path string, sheet_index int, sheet_name string, sheet_state string, "
    "max_row bigint, max_column int, row_idx bigint, cells array<string>, error string"
)
BATCH_ROWS = 5000
MOST_TASKS = 10_000
# Fixed value: bytes of an empty archive.
SMALLEST_ZIP = 22

# Built-in number formats that show a date or a time.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node) -> str:
    """Text of a string item; phonetic guides do not count."""
    out = []
    for child in node:
        if _local(child.tag) == "t":
            out.append(child.text or "")
        elif _local(child.tag) == "r":
            out.extend(t.text or "" for t in child if _local(t.tag) == "t")
    return "".join(out)


class _Book:
    """The parts of one workbook that its sheets need."""

    def __init__(self, file, cells: bool = True):
        """``file`` is open for reading at any place; without ``cells`` only the list of sheets is read."""
        self.zip = zipfile.ZipFile(file)
        root = self._xml("xl/workbook.xml")
        targets = {
            r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")
        }
        self.sheets = []
        self.epoch = datetime(1899, 12, 30)
        for node in root.iter():
            name = _local(node.tag)
            if name == "workbookPr" and node.get("date1904") in ("1", "true"):
                self.epoch = datetime(1904, 1, 1)
            elif name == "sheet":
                link = next(v for k, v in node.attrib.items() if _local(k) == "id" and k != "id")
                target = targets[link]
                path = target.lstrip("/") if target.startswith("/") else "xl/" + target
                self.sheets.append((node.get("name"), node.get("state", "visible"), path))
        if not cells:
            return
        names = set(self.zip.namelist())
        self.strings = []
        if "xl/sharedStrings.xml" in names:
            self.strings = [_texts(n) for n in self._xml("xl/sharedStrings.xml") if _local(n.tag) == "si"]
        self.date_styles = self._date_styles() if "xl/styles.xml" in names else set()

    def _xml(self, path: str):
        return ElementTree.fromstring(self.zip.read(path))

    def _date_styles(self) -> set[int]:
        root = self._xml("xl/styles.xml")
        formats = set(DATE_FORMATS)
        for node in root.iter():
            if _local(node.tag) == "numFmt":
                code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", node.get("formatCode", "").lower())
                (formats.add if re.search("[dmhysa]", code.replace("general", "")) else formats.discard)(
                    int(node.get("numFmtId"))
                )
        styles = next((n for n in root if _local(n.tag) == "cellXfs"), ())
        return {i for i, xf in enumerate(styles) if int(xf.get("numFmtId", 0)) in formats}

    def _number(self, text: str, style: str | None) -> str:
        value = float(text)
        if style is not None and int(style) in self.date_styles:
            if 0 <= value < 1:
                return str((datetime.min + timedelta(seconds=round(value * 86400))).time())
            days = value + 1 if self.epoch.year == 1899 and value < 60 else value
            return str(self.epoch + timedelta(milliseconds=round(days * 86400000)))
        return str(int(value)) if value == int(value) else str(value)

    def _value(self, cell) -> str | None:
        kind, style, raw, inline = cell.get("t", "n"), cell.get("s"), None, None
        for child in cell:
            if _local(child.tag) == "v":
                raw = child.text
            elif _local(child.tag) == "is":
                inline = _texts(child)
        if kind == "inlineStr":
            text = inline
        elif raw is None or kind == "e":
            text = None
        elif kind == "s":
            text = self.strings[int(raw)]
        elif kind == "b":
            text = "True" if raw == "1" else "False"
        elif kind == "n":
            text = self._number(raw, style)
        elif kind == "d":
            text = str(datetime.fromisoformat(raw.replace("Z", "+00:00")).replace(tzinfo=None))
        else:
            text = raw
        return None if text is None or text in NULL_TOKENS else text

    def rows(self, path: str) -> Iterator[tuple[int, dict[int, str]]]:
        """Stored rows of a sheet in file order: position and non-empty cells."""
        at = -1
        with self.zip.open(path) as stream:
            parent = None
            for event, node in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    parent = node if _local(node.tag) == "sheetData" else parent
                    continue
                if _local(node.tag) != "row":
                    continue
                at = int(node.get("r")) - 1 if node.get("r") else at + 1
                cells, column = {}, -1
                for cell in node:
                    if _local(cell.tag) != "c":
                        continue
                    ref = cell.get("r")
                    column = _column(ref) if ref else column + 1
                    value = self._value(cell)
                    if value is not None:
                        cells[column] = value
                yield at, cells
                if parent is not None:
                    parent.clear()  # rows that are done leave no empty nodes behind


def _column(reference: str) -> int:
    number = 0
    for char in reference:
        if not char.isalpha():
            break
        number = number * 26 + ord(char.upper()) - 64
    return number - 1


def _sheet_records(book: _Book, path: str) -> Iterator[dict]:
    """A sheet fact record, then its rows, padded to one width, gaps filled."""
    width = last = 0
    for at, cells in book.rows(path):
        if cells:
            last, width = max(last, at + 1), max(width, max(cells) + 1)
    yield {"kind": "sheet", "max_row": last, "max_column": width}
    expected = 0
    for at, cells in book.rows(path):
        if at >= last:
            break
        while expected < at:
            yield {"kind": "row", "row_idx": expected, "cells": [None] * width}
            expected += 1
        yield {"kind": "row", "row_idx": at, "cells": [cells.get(i) for i in range(width)]}
        expected = at + 1


def _wrong(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"


def _book_records(path: str, book: _Book, wanted: set[int] | None = None) -> Iterator[dict]:
    """Records of the sheets (of those at the wanted places)."""
    for index, (name, state, part) in enumerate(book.sheets):
        if wanted is not None and index not in wanted:
            continue
        fixed = {"source_path": path, "sheet_index": index, "sheet_name": name, "sheet_state": state}
        try:
            for record in _sheet_records(book, part):
                yield {**fixed, **record}
        except Exception as problem:  # a damaged sheet must not stop the others
            yield {**fixed, "kind": "error", "error": _wrong(problem)}


def _records(path: str, content: bytes | None, error: str | None = None) -> Iterator[dict]:
    if error is not None or content is None:
        yield {"kind": "error", "source_path": path, "error": error or "File could not be read"}
        return
    try:
        book = _Book(io.BytesIO(content))
    except Exception as problem:  # a damaged file must not stop the others
        yield {"kind": "error", "source_path": path, "error": _wrong(problem)}
        return
    yield from _book_records(path, book)


def _in_place(path: str, cells: bool = True) -> _Book:
    """The workbook at a path, read where its parts lie."""
    system, place = opened(path)
    file = system.open_input_file(place)
    if file.size() < SMALLEST_ZIP:
        # Arrow's files have an error of their own for places before the start.
        raise zipfile.BadZipFile("File is not a zip file")
    return _Book(file, cells)


def _listed(path: str, patterns: Sequence[str] | None) -> Iterator[tuple]:
    """(path, sheet_index, error) of a file's sheets, those whose names match; a file that cannot be read has one row."""
    try:
        sheets = _in_place(path, cells=False).sheets
    except Exception as problem:  # a damaged file must not stop the others
        yield path, None, _wrong(problem)
        return
    for index, (name, _, _) in enumerate(sheets):
        if patterns is None or any(fnmatchcase(name.lower(), p.lower()) for p in patterns):
            yield path, index, None


def _sheets_in_place(path: str, wanted: list[int]) -> Iterator[dict]:
    """Records of some sheets of a file, read from their places in it."""
    try:
        yield from _book_records(path, _in_place(path), set(wanted))
    except Exception as problem:  # a damaged file must not stop the others
        for index in wanted:
            yield {"kind": "error", "source_path": path, "sheet_index": index, "error": _wrong(problem)}


def _frame(records: list[dict]) -> pd.DataFrame:
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    frame = pd.DataFrame({n: pd.Series([r.get(n) for r in records], dtype=object) for n in names})
    for name in ("sheet_index", "max_row", "max_column", "row_idx"):
        frame[name] = frame[name].astype("Int64")
    return frame


def parse_workbooks(files: DataFrame) -> DataFrame:
    """Records of binary files (``path, content`` and, if there, ``error``): sheet facts, rows and errors.

    Spark bounds the bytes of an Arrow batch, so a task holds a few files at a time.
    A file with an ``error`` gives one error record; it is not parsed.
    """
    ship_package(files.sparkSession)
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string").alias("error")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (
            record
            for batch in batches
            for path, content, wrong in zip(batch["path"], batch["content"], batch["error"])
            for record in _records(path, content, wrong)
        )
        yield from _frames(found)

    return files.select("path", "content", error).mapInPandas(parse, RECORD_SCHEMA)


def _frames(records: Iterator[dict]) -> Iterator[pd.DataFrame]:
    records = iter(records)
    while rows := list(islice(records, BATCH_ROWS)):
        yield _frame(rows)


def list_sheets(files: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The sheets of files (``path``): ``path, sheet_index, error``; of a file only the list of its sheets is read.

    ``names`` are glob patterns, in any letter case, for the names of the sheets wanted.
    """
    ship_package(files.sparkSession)
    wanted = None if names is None else list(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for path in batch["path"] for row in _listed(path, wanted)]
            frame = pd.DataFrame(rows, columns=["path", "sheet_index", "error"], dtype=object)
            yield frame.astype({"sheet_index": "Int32"})

    return files.select("path").mapInPandas(run, "path string, sheet_index int, error string")


def parse_sheets(sheets: DataFrame) -> DataFrame:
    """Records of listed sheets, each read by a task of its own.

    A task opens the file and reads the shared strings and its sheet; nothing of the other sheets
    is read, and no file goes through a shuffle.
    """
    ship_package(sheets.sparkSession)
    kept = materialize(sheets)
    # Sheets are dealt out one by one: a hash of so few rows would leave tasks idle.
    numbered = number_within(kept, [], ["path", "sheet_index"], "_at")
    tasks = max(1, min(kept.count(), MOST_TASKS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[dict]:
            for batch in batches:
                for path, index, wrong in zip(batch["path"], batch["sheet_index"], batch["error"]):
                    if wrong is not None:
                        yield {"kind": "error", "source_path": path, "error": wrong}
                    else:
                        yield from _sheets_in_place(path, [int(index)])

        yield from _frames(found())

    dealt = numbered.repartitionById(tasks, F.pmod(F.col("_at"), F.lit(tasks)).cast("int"))
    return dealt.select("path", "sheet_index", "error").mapInPandas(run, RECORD_SCHEMA)


def read_workbooks(spark: SparkSession, watch: WatchSettings, names: Sequence[str] | None = None) -> DataFrame:
    """Records of all ``.xlsx`` files of the folders; one beyond the size limit gives an error record.

    Files of other names are not opened, contents beyond the limit are not read, and
    every sheet (of those that match ``names``) is parsed once: the records are kept.
    Where Arrow does not know the file system, whole files are read by Spark, one task a file.
    """
    reader = spark.read.format("binaryFile")
    if (glob := name_glob(watch.patterns)) is not None:
        reader = reader.option("pathGlobFilter", glob)
    listing = reader.load(list(watch.folders))
    name = file_name(F.col("path"))
    taken = listing.where(match_glob(name, watch.patterns) & F.lower(name).endswith(".xlsx"))
    limit = int(watch.max_file_mb * MEGABYTE)
    large = taken.where(F.col("length") > limit).select("path", too_large(F.col("length"), watch.max_file_mb).alias("error"))
    small = taken.where(F.col("length") <= limit)
    if all(known(folder) for folder in watch.folders):
        refused = large.select("path", F.lit(None).cast("int").alias("sheet_index"), "error")
        return materialize(parse_sheets(list_sheets(small.select("path"), names).unionByName(refused)))
    read = small.select("path", "content", F.lit(None).cast("string").alias("error"))
    refused = large.select("path", F.lit(None).cast("binary").alias("content"), "error")
    records = parse_workbooks(read.unionByName(refused))
    if names is not None:
        records = records.where(F.col("sheet_name").isNull() | match_glob(F.col("sheet_name"), tuple(names)))
    return materialize(records)


def _table_id():
    return F.concat_ws("#", "source_path", "sheet_name").alias("table_id")


def workbook_grid(records: DataFrame) -> DataFrame:
    """Grid rows of the sheets; a sheet whose reading failed half way is left out."""
    rows = records.where(F.col("kind") == "row").select(
        _table_id(), "row_idx", "cells"
    )
    broken = workbook_errors(records).where(F.col("sheet_name").isNotNull()).select("table_id").distinct()
    return as_grid(join_small(rows, broken, ["table_id"], "left_anti"))


def workbook_sheets(records: DataFrame) -> DataFrame:
    """Every listed sheet with its size and state, empty ones included."""
    return records.where(F.col("kind") == "sheet").select(
        _table_id(), "source_path", "sheet_index", "sheet_name", "sheet_state", "max_row", "max_column"
    )


def workbook_errors(records: DataFrame) -> DataFrame:
    return records.where(F.col("kind") == "error").select(_table_id(), "source_path", "sheet_name", "error")
