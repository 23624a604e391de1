"""Which of the first rows is a header, and how good it is.

Scores are kept as whole tenths, so sums are exact and ties are real ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.functions import (
    contains_any,
    is_alpha_label,
    is_date,
    is_digit_label,
    is_header_word,
    is_number,
    strip,
)
from gridsift.operators.grid import GridSource
from gridsift.operators.profile import first_values

CANDIDATE_ROWS = 5
BELOW = 3
#: So many first values of a column decide on its header.
EARLY_VALUES = CANDIDATE_ROWS + BELOW

# Words that make a cell look like a label, and words that promise
# a kind of data below.
LABEL_WORDS = ("id", "name", "date", "value", "code", "type")
DATE_WORDS = ("date", "time", "timestamp")
NUMBER_WORDS = ("amount", "value", "count", "number", "price", "cost")
KEY_WORDS = ("id", "identifier", "key", "code")

NO_HEADER_SCORE = 0.3


def _data_bonus(name: Column, below: Column) -> Column:
    """Tenths earned when the first values below fit the header's promise."""
    lengths = F.aggregate(below, F.lit(0), lambda total, v: total + F.length(v))
    mean_length = lengths / F.size(below)
    return (
        F.when(F.size(below) == 0, 0)
        .when(contains_any(name, DATE_WORDS) & F.forall(below, is_date), 2)
        .when(contains_any(name, NUMBER_WORDS) & F.forall(below, is_number), 1)
        .when(contains_any(name, KEY_WORDS) & mean_length.between(2, 20), 1)
        .otherwise(0)
    )


def header_cells(
    grid: DataFrame, columns: DataFrame, top: DataFrame, sources: Sequence[GridSource] = ()
) -> DataFrame:
    """Score of every cell of the first five rows as a column header.

    ``top`` holds at least the first five rows of every table (``head_rows``).
    """
    return score_cells(first_values(grid, EARLY_VALUES, columns, top, sources), top)


def score_cells(values: DataFrame, top: DataFrame) -> DataFrame:
    """The same from the first ``EARLY_VALUES`` values of every column (``first_values``).

    Returns ``table_id, rank, col_idx, name, tenths, good``.
    """
    early = values.groupBy("table_id", "col_idx").agg(
        F.sort_array(F.collect_list(F.struct("nth", "rank", "value"))).alias("_early")
    )
    first = top.where(F.col("rank") < CANDIDATE_ROWS)
    cells = first.select("table_id", "rank", F.posexplode("cells").alias("col_idx", "value"))
    cells = cells.join(early, ["table_id", "col_idx"], "left")

    name = F.coalesce(strip(F.col("value")), F.lit(""))
    later = F.filter("_early", lambda e: e["rank"] > F.col("rank"))
    below = F.coalesce(
        F.transform(F.slice(later, 1, BELOW), lambda e: e["value"]), F.array().cast("array<string>")
    )
    cells = cells.select("table_id", "rank", "col_idx", name.alias("name"), below.alias("_below"))

    name, size = F.col("name"), F.length("name")
    tenths = (
        F.when(size.between(2, 50), 3).when(size > 50, -2).otherwise(0)
        + F.when(is_alpha_label(name), 4).otherwise(0)
        + F.when(is_header_word(name), 2).otherwise(0)
        + F.when(contains_any(name, LABEL_WORDS), 1).otherwise(0)
        - F.when(is_digit_label(name), 3).otherwise(0)
        + _data_bonus(name, F.col("_below"))
    )
    tenths = F.when(size == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(10), tenths)))
    scored = cells.select("table_id", "rank", "col_idx", "name", tenths.alias("tenths"))
    # The limit is "above 0.3".  A long alphabetic cell reaches 0.3 as 0.2 + 0.1, which
    # lies above 0.3 in binary arithmetic, and counts as good.
    good = (F.col("tenths") > 3) | ((F.col("tenths") == 3) & (F.length("name") > 50))
    return scored.withColumn("good", good)


def header_rows(cells: DataFrame) -> DataFrame:
    """Score of each candidate row; ``points`` out of ``10 * columns``."""
    rows = cells.groupBy("table_id", "rank").agg(
        F.count(F.lit(1)).alias("columns"),
        F.sum("tenths").alias("_tenths"),
        F.sum(F.when(F.col("good"), 2).otherwise(0)).alias("_good"),
        F.sum(F.when(F.col("name") != "", 1).otherwise(0)).alias("_named"),
    )
    points = F.least(F.col("_tenths") + F.col("_good") + F.col("_named"), F.col("columns") * 10)
    return rows.select(
        "table_id", "rank", "columns",
        points.cast("long").alias("points"),
        (points / (F.col("columns") * 10)).alias("score"),
    )


def best_header_row(rows: DataFrame) -> DataFrame:
    """The best candidate per table; the earliest row wins ties."""
    best = F.max(F.struct("points", (-F.col("rank")).alias("_early"), "columns", "score")).alias("_best")
    return rows.groupBy("table_id").agg(best).select(
        "table_id",
        (-F.col("_best._early")).alias("rank"),
        F.col("_best.points").alias("points"),
        F.col("_best.columns").alias("columns"),
        F.col("_best.score").alias("score"),
    )


def header_quality(best: DataFrame) -> DataFrame:
    """Header component score and its reason.

    A table without a header gets a fixed score; tables can exist without one.
    """
    points, wide = F.col("points"), F.col("columns")
    found = points > 3 * wide
    grade = F.when(points > 8 * wide, "High").when(points > 6 * wide, "Moderate").otherwise("Low")
    reason = F.concat(
        grade, F.lit(" quality headers detected (row "), F.col("rank").cast("string"), F.lit(")")
    )
    return best.select(
        "table_id",
        found.alias("has_headers"),
        F.when(found, F.col("rank")).alias("header_row"),
        F.when(found, F.col("score")).otherwise(F.lit(NO_HEADER_SCORE)).alias("header_score"),
        F.when(found, reason).otherwise(F.lit("No clear header row detected")).alias("header_reason"),
    )


def header_names(cells: DataFrame, quality: DataFrame) -> DataFrame:
    """Column names of the detected header row, in column order."""
    chosen = quality.where(F.col("has_headers")).select("table_id", F.col("header_row").alias("rank"))
    named = cells.join(chosen, ["table_id", "rank"])
    ordered = F.array_sort(F.collect_list(F.struct("col_idx", "name")))
    names = named.groupBy("table_id").agg(F.transform(ordered, lambda c: c["name"]).alias("column_names"))
    return quality.join(names, "table_id", "left").select(
        "table_id", "has_headers", "header_row",
        F.col("header_score").alias("header_quality"),
        F.coalesce("column_names", F.array().cast("array<string>")).alias("column_names"),
    )


def _first_two(top: DataFrame) -> DataFrame:
    """Cells of the first and second row side by side."""
    top = top.where(F.col("rank") < 2)
    pick = [F.max(F.when(F.col("rank") == i, F.col("cells"))).alias(f"row{i}") for i in (0, 1)]
    return top.groupBy("table_id").agg(*pick)


def _share(pairs: Column, test) -> Column:
    return F.size(F.filter(pairs, lambda p: F.coalesce(test(p), F.lit(False)))) / F.size(pairs)


def _is_text(value: Column) -> Column:
    return value.isNotNull() & (strip(value) != "")


def first_row_is_header(top: DataFrame) -> DataFrame:
    """Header rule used for delivery.

    More than 60% text in the first row; else more than 30% of the columns go
    from text in the first row to digits in the second.
    """
    two = _first_two(top)
    pairs = F.when(
        F.col("row1").isNotNull(),
        F.zip_with("row0", "row1", lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
    ).otherwise(F.transform("row0", lambda a: F.struct(a.alias("a"), F.lit(None).cast("string").alias("b"))))
    texts = _share(pairs, lambda p: _is_text(p["a"]))
    changes = _share(
        pairs,
        lambda p: p["a"].isNotNull() & p["b"].isNotNull() & ~is_digit_label(p["a"]) & is_digit_label(p["b"]),
    )
    return two.select(
        "table_id",
        texts.alias("text_ratio"),
        changes.alias("change_ratio"),
        ((texts > 0.6) | (changes > 0.3)).alias("is_header"),
    )


def has_headers_simple(top: DataFrame) -> DataFrame:
    """At least half text in the first row, and fewer texts in the second."""
    two = _first_two(top)

    def texts(row: str) -> Column:
        return F.size(F.filter(row, _is_text))

    rule = F.col("row1").isNotNull() & (texts("row0") >= F.size("row0") * 0.5) & (texts("row1") < texts("row0"))
    return two.select("table_id", F.coalesce(rule, F.lit(False)).alias("has_headers"))
