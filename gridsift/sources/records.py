"""Records of delimited files whose quoted cells hold line feeds, read by all tasks of a file.

Whether a line stands inside a quoted cell depends on all lines before it.  A line
without quotes changes nothing, and any other line maps "outside" and "inside" to what
comes after it; so does a block of lines, as the chain of its lines.  One pass takes the
map of every block, the maps are chained over the blocks of a file, and a second pass
cuts each block into records from the state it begins in.  Pieces of records that cross
blocks, at most two for each block, are put together last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.session import materialize, ship_package

QUOTE = '"'


def ends_inside(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted cell, or at the start of a cell, ends inside one.

    Quotes are doubled within a quoted cell; a quote that does not begin a cell is an ordinary sign.
    """
    at = 0
    while True:
        if not inside and line.startswith(QUOTE, at):
            inside, at = True, at + 1
        while inside:
            close = line.find(QUOTE, at)
            if close < 0:
                return True
            inside = line.startswith(QUOTE, close + 1)
            at = close + 1 + inside
        cut = line.find(delimiter, at)
        if cut < 0:
            return False
        at = cut + 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array, bool]]:
    """(file, block), lines and whether the block begins here, for each run of lines of one block."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(1).to_numpy(zero_copy_only=False)
        path = batch.column(0).dictionary_encode()
        code = path.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = (path[a].as_py(), int(block[a]))
            yield key, batch.column(2).slice(a, b - a), key != before
            before = key


def _quoted(lines: pa.Array) -> list[int]:
    return np.flatnonzero(pc.match_substring(lines, QUOTE).to_numpy(zero_copy_only=False)).tolist()


def _maps(delimiter: str) -> Callable:
    """Lines to one row for each block: where it leads from outside and from inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def told():
            (path, block), ends = held
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([ends[False]]), pa.array([ends[True]])], ["path", "block", "from_outside", "from_inside"])

        for key, lines, new in _blocks(batches):
            if new:
                if held:
                    yield told()
                held = (key, {False: False, True: True})
            ends = held[1]
            for k in _quoted(lines):
                line = lines[k].as_py()
                step = {start: ends_inside(line, delimiter, start) for start in set(ends.values())}
                for start in ends:
                    ends[start] = step[ends[start]]
        if held:
            yield told()

    return run


def _pieces(delimiter: str, open_blocks: frozenset[tuple[str, int]]) -> Callable:
    """Lines to records and pieces of records: path, block, number of the first line, text, follows, goes_on."""
    names = ["path", "block", "line", "text", "follows", "goes_on"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, follows, number, first, kept = None, False, False, 0, 0, []

        def rest():
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()), pa.array(["\n".join(kept)]), pa.array([follows]), pa.array([True])], names)

        for now, lines, new in _blocks(batches):
            if new:
                yield from rest()
                key, number, kept = now, 0, []
                inside = follows = now in open_blocks
            ends = np.zeros(len(lines), bool)  # whether a line ends a record
            state, at = inside, 0
            for k in _quoted(lines):
                ends[at:k] = not state
                state = ends_inside(lines[k].as_py(), delimiter, state)
                ends[k], at = not state, k + 1
            ends[at:] = not state
            inside = state
            last = np.flatnonzero(ends)
            if len(last):
                # Records as lists of lines, joined by line feeds; the first takes what was kept.
                begins = np.concatenate([[0], last[:-1] + 1])
                upto = pa.array(np.append(begins, last[-1] + 1).astype(np.int32))
                texts = pc.binary_join(pa.ListArray.from_arrays(upto, lines.slice(0, int(last[-1]) + 1)), "\n")
                starts = begins + number
                if kept:
                    head = "\n".join([*kept, texts[0].as_py()])
                    texts = pa.concat_arrays([pa.array([head], texts.type), texts.slice(1)])
                    starts[0] = first
                flags = np.zeros(len(last), bool)
                flags[0] = follows
                n = len(last)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array(np.full(n, key[1])), pa.array(starts), texts, pa.array(flags), pa.array(np.zeros(n, bool))], names)
                kept, follows = [], False
                left = lines.slice(int(last[-1]) + 1)
                first = number + int(last[-1]) + 1
            else:
                left = lines
                first = first if kept else number
            kept += left.to_pylist()
            number += len(lines)
        yield from rest()

    return run


def quoted_records(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """``path, block, line, record``: records in the order of block and line, each whole, without its line end.

    Lines end in a line feed, with or without a carriage return; a record without any sign
    is left out.  A quoted cell that is never closed takes the rest of its file.  Files are
    split as Spark splits text; the driver learns which blocks begin inside a cell, one
    entry for each such block.
    """
    ship_package(spark)
    plain = encoding.lower().replace("-", "").replace("_", "") == "utf8"
    lines = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    text = F.col("value") if plain else F.decode(F.col("value").cast("binary"), encoding)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), text.alias("value"))
    maps = materialize(lines.mapInArrow(_maps(delimiter), "path string, block long, from_outside boolean, from_inside boolean"))

    # The state before a block: that after the last block that leads to one state, turned by each block since that turns it.
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    settles = F.col("from_outside") == F.col("from_inside")
    turns = maps.withColumn("turned", F.sum((~settles & F.col("from_outside")).cast("int")).over(upto))
    settled = F.last(F.when(settles, F.struct(F.col("from_outside").alias("state"), "turned")), True).over(before)
    so_far = F.coalesce(F.max("turned").over(before), F.lit(0))
    states = turns.select("path", "block", settled.alias("settled"), so_far.alias("so_far"))
    odd = (F.col("so_far") - F.coalesce("settled.turned", F.lit(0))) % 2 == 1
    begins_inside = F.coalesce("settled.state", F.lit(False)) != odd
    open_blocks = frozenset((r["path"], r["block"]) for r in states.where(begins_inside).select("path", "block").collect())

    pieces = lines.mapInArrow(_pieces(delimiter, open_blocks), "path string, block long, line long, text string, follows boolean, goes_on boolean")
    whole = pieces.where("NOT follows AND NOT goes_on").select("path", "block", "line", "text")
    if open_blocks:
        crossing = pieces.where("follows OR goes_on")
        chain = Window.partitionBy("path").orderBy("block", "line").rowsBetween(Window.unboundedPreceding, 0)
        crossing = crossing.withColumn("chain", F.sum((~F.col("follows")).cast("int")).over(chain))
        parts = F.sort_array(F.collect_list(F.struct("block", "line", "text")))
        joined = crossing.groupBy("path", "chain").agg(parts.alias("parts")).select(
            "path", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["line"].alias("line"),
            F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"),
        )
        whole = whole.unionByName(joined)
    else:
        # What goes on at the end of a file is never closed.
        whole = whole.unionByName(pieces.where("goes_on").select("path", "block", "line", "text"))
    record = F.regexp_replace("text", "\r\\z", "")
    return whole.select("path", "block", "line", record.alias("record")).where("record <> ''")
