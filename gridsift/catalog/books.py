"""Workbooks made of table rows, for the queries that read workbooks."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsift.session import ship_package
from gridsift.sources.moves import opened

# Names that the file format prescribes.
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def _row(cells) -> str:
    inner = "".join("<c/>" if c is None else f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in cells)
    return f"<row>{inner}</row>"


def _write(target, rows: pd.DataFrame, header: list[str]) -> int:
    """One workbook of (sheet, row, cells) rows; every sheet has the header in front."""
    names = sorted(rows["sheet"].unique())
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
        for n, name in enumerate(names):
            cells = rows[rows["sheet"] == name].sort_values("row")["cells"]
            body = "".join(_row(c) for c in [header, *cells])
            book.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
        listed = "".join(f'<sheet name="{escape(name)}" sheetId="{n + 1}" r:id="r{n}"/>' for n, name in enumerate(names))
        book.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{LINKS}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(len(names)))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {PACKAGE}>{links}</Relationships>")
    return len(names)


def write_books(rows: DataFrame, path: str, header: list[str]) -> int:
    """Write (book, sheet, row, cells) rows as one file per book, each by a task; returns the number of sheets.

    A book must be small enough for a task, as a workbook is.
    """
    ship_package(rows.sparkSession)

    def write(book: pd.DataFrame) -> pd.DataFrame:
        system, folder = opened(path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{book['book'].iloc[0]}") as target:
            return pd.DataFrame({"sheets": [_write(target, book, header)]})

    return rows.groupBy("book").applyInPandas(write, "sheets long").agg(F.coalesce(F.sum("sheets"), F.lit(0)).alias("n")).first()["n"]
