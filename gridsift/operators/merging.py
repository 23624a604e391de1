"""Profiles that merge: what is known of a table whose rows arrive in parts.

A part holds small frames only: the column profile, the first rows, the first values of
every column, a sketch of the distinct values of every column, and, where neither
numbers nor dates settle a column, the distinct values themselves (long ones as
digests).  Parts of a table add up to what one pass over all its rows would have found, so
``confidence`` judges a merged profile as it judges a grid, without the rows.

Positions must order the rows of a table over all parts and not repeat.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsift.operators.confidence import TOP_ROWS, Profile, profile
from gridsift.operators.consistency import needs_distinct
from gridsift.operators.grid import _tie
from gridsift.operators.headers import EARLY_VALUES
from gridsift.operators.profile import first_values, table_profile, value_key
from gridsift.plans import join_small
from gridsift.session import materialize

#: The frames of a part, with their schemas.
SCHEMAS = {
    "columns": (
        "table_id string, col_idx int, rows bigint, n bigint, numbers bigint, dates bigint, length bigint, length2 double, "
        "rows_any bigint, rows_full bigint, filled2 double, last_position bigint, exact boolean"
    ),
    "top": "table_id string, row_idx bigint, cells array<string>, filled int",
    "early": "table_id string, col_idx int, row_idx bigint, value string",
    "sketches": "table_id string, col_idx int, sketch binary",
    "keys": "table_id string, col_idx int, key string",
}
#: Frames that stay small, whatever the number of rows; ``keys`` grows with the distinct values.
SMALL = ("columns", "top", "early", "sketches")
SKETCH_BITS = 14
_SUMS = ("rows", "n", "numbers", "dates", "length", "length2", "rows_any", "rows_full", "filled2")


def _like(df: DataFrame, name: str) -> DataFrame:
    fields = [f.split() for f in SCHEMAS[name].split(", ")]
    return df.select(*[F.col(field).cast(kind).alias(field) for field, kind in fields])


def part(grid: DataFrame, exact: bool = True) -> dict[str, DataFrame]:
    """The frames of the rows of ``grid``, which are read several times: keep them first.

    Without ``exact`` no distinct values are kept, so a part is small throughout.
    """
    known = profile(grid)
    place = F.row_number().over(Window.partitionBy("table_id").orderBy("row_idx", _tie()))
    # Tasks cut their rows to the first ones before these are dealt out.
    top = materialize(grid.withColumn("rank", place - 1).where(F.col("rank") < TOP_ROWS))
    # A column is settled or not in each part; what an unsettled part holds can be counted exactly.
    unsettled = F.greatest("numbers", "dates") / F.nullif(F.col("n"), F.lit(0)) <= 0.9
    columns = known.columns.withColumn("exact", (F.col("n") == 0) | (unsettled if exact else F.lit(False)))
    cells = grid.select("table_id", F.posexplode_outer("cells").alias("col_idx", "value")).where(F.col("value").isNotNull())
    keyed = cells.select("table_id", "col_idx", value_key(F.col("value")).alias("key"))
    kept = columns.where("exact AND n > 0").select("table_id", "col_idx")
    sketch = F.hll_sketch_agg("key", F.lit(SKETCH_BITS))
    frames = {
        "columns": columns,
        "top": top,
        "early": first_values(grid, EARLY_VALUES, known.columns, top, positions=True),
        "sketches": keyed.groupBy("table_id", "col_idx").agg(sketch.alias("sketch")),
        "keys": join_small(keyed, kept, ["table_id", "col_idx"], "left_semi").distinct(),
    }
    return {name: _like(frame, name) for name, frame in frames.items()}


def _first(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def merged(known: Mapping[str, DataFrame], more: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Two parts as one; each frame stays as small as its tables and columns ask for.

    ``keys`` are put together as they are and may repeat; they are counted when judged.
    """
    both = {name: known[name].unionByName(more[name]) for name in SCHEMAS}
    column = ["table_id", "col_idx"]
    return {
        "columns": _like(both["columns"].groupBy(*column).agg(
            *[F.sum(c).alias(c) for c in _SUMS], F.max("last_position").alias("last_position"), F.bool_and("exact").alias("exact")
        ), "columns"),
        "top": _first(both["top"], ["table_id"], ["row_idx", _tie()], TOP_ROWS),
        "early": _first(both["early"], column, ["row_idx", "value"], EARLY_VALUES),
        "sketches": both["sketches"].groupBy(*column).agg(F.hll_union_agg("sketch", F.lit(False)).alias("sketch")),
        "keys": both["keys"],
    }


@dataclass(frozen=True)
class MergedProfile(Profile):
    """A profile out of the frames of a part.  Its ``grid`` holds the first rows of the tables only."""

    frames: Mapping[str, DataFrame] | None = None

    @cached_property
    def top(self) -> DataFrame:
        place = Window.partitionBy("table_id").orderBy("row_idx", _tie())
        return self.frames["top"].withColumn("rank", F.row_number().over(place) - 1)

    def early(self, columns: DataFrame) -> DataFrame:
        # Positions do not repeat, so what lies behind the first rows is told by its position.
        shown = self.top.select("table_id", "row_idx", "rank", F.posexplode_outer("cells").alias("col_idx", "value"))
        shown = shown.where(F.col("value").isNotNull())
        cut = self.top.groupBy("table_id").agg(F.max("row_idx").alias("_cut"))
        behind = self.frames["early"].join(cut, "table_id").where("row_idx > _cut").withColumn("rank", F.lit(2**31 - 1))
        by_rank = Window.partitionBy("table_id", "col_idx").orderBy("rank", "row_idx", "value")
        values = shown.unionByName(behind.drop("_cut")).withColumn("nth", F.row_number().over(by_rank))
        values = values.where(F.col("nth") <= EARLY_VALUES).select("table_id", "col_idx", "nth", "rank", "value")
        return values.join(columns.select("table_id", "col_idx"), ["table_id", "col_idx"], "left_semi")

    def distinct(self, wanted: DataFrame) -> DataFrame:
        """Exact numbers where every part kept its values, else estimates (1.6 % standard error at most)."""
        column = ["table_id", "col_idx"]
        asked = self.columns.select(*column, "exact").join(wanted, column, "left_semi")
        exact = join_small(self.frames["keys"], asked.where("exact").select(*column), column, "left_semi").distinct()
        exact = exact.groupBy(*column).agg(F.count(F.lit(1)).alias("distinct_values"))
        near = self.frames["sketches"].join(asked.where("NOT exact").select(*column), column, "left_semi")
        return exact.unionByName(near.select(*column, F.hll_sketch_estimate("sketch").alias("distinct_values")))


def merged_profile(frames: Mapping[str, DataFrame]) -> MergedProfile:
    """What ``confidence`` takes, out of the frames of a part."""
    columns = frames["columns"]
    return MergedProfile(frames["top"], columns, table_profile(columns), False, (), frames)


def inexact(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Columns whose distinct values count and are only estimated: their kind changed between parts."""
    columns = frames["columns"].where("NOT exact")
    return needs_distinct(columns)
