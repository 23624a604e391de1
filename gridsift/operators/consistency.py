"""Consistency score: how uniform the values of each column are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.functions import fixed
from gridsift.operators.density import _deviation
from gridsift.operators.grid import GridSource
from gridsift.operators.profile import distinct_counts


def _graded(share: Column, high: float, good: float, fair: float, rest: float) -> Column:
    return (
        F.when(share > 0.9, F.lit(high))
        .when(share > 0.8, F.lit(good))
        .when(share > 0.6, F.lit(fair))
        .otherwise(share * rest)
    )


def numeric_consistency(columns: DataFrame) -> DataFrame:
    """Share of number cells among the non-null cells of a column, graded."""
    share = F.col("numbers") / F.col("n")
    scored = columns.where(F.col("n") > 0)
    return scored.withColumn("numeric_score", _graded(share, 0.95, 0.8, 0.6, 0.5))


def date_consistency(columns: DataFrame) -> DataFrame:
    """Share of date cells among the non-null cells of a column, graded."""
    share = F.col("dates") / F.col("n")
    scored = columns.where(F.col("n") > 0)
    return scored.withColumn("date_score", _graded(share, 0.9, 0.75, 0.6, 0.4))


def categorical_consistency(columns: DataFrame) -> DataFrame:
    """Even text lengths and a healthy share of distinct values.

    Needs ``distinct_values``; where that is null the score is null.
    """
    n = F.col("n")
    mean = F.col("length") / n
    spread = F.coalesce(_deviation(F.col("length"), F.col("length2"), n), F.lit(0.0))
    even = F.when(mean > 0, F.greatest(F.lit(0.0), 1 - spread / mean)).otherwise(F.lit(0.0))
    unique = F.col("distinct_values") / n
    pattern = (
        F.when(unique.between(0.1, 0.8), F.lit(0.8)).when(unique < 0.1, F.lit(0.6)).when(unique > 0.8, F.lit(0.4))
    )
    scored = columns.where(n > 0)
    return scored.withColumn("categorical_score", (even + pattern) / 2)


def needs_distinct(columns: DataFrame) -> DataFrame:
    """Columns that neither numbers nor dates settle: only these must be counted exactly."""
    settled = (F.col("numbers") / F.col("n") > 0.9) | (F.col("dates") / F.col("n") > 0.9)
    return columns.where((F.col("n") > 1) & ~settled).select("table_id", "col_idx")


def column_consistency(columns: DataFrame) -> DataFrame:
    """Score per column; needs ``distinct_values`` of the columns ``needs_distinct`` names."""
    scored = categorical_consistency(date_consistency(numeric_consistency(columns)))
    numeric, date = F.col("numeric_score"), F.col("date_score")
    best = F.greatest(numeric, date, F.coalesce("categorical_score", F.lit(0.0)))
    score = (
        F.when(F.col("n") <= 1, F.lit(0.5)).when(numeric > 0.8, numeric).when(date > 0.8, date).otherwise(best)
    )
    return scored.withColumn("column_score", score)


def score_columns(
    grid: DataFrame, columns: DataFrame, sources: Sequence[GridSource] = ()
) -> DataFrame:
    """Column scores straight from a grid and its column profile."""
    counts = distinct_counts(grid, needs_distinct(columns), sources)
    return column_consistency(columns.join(counts, ["table_id", "col_idx"], "left"))


def table_consistency(scored: DataFrame) -> DataFrame:
    """Table score from its column scores, with a bonus or a cut by the share of good columns.

    Tables with empty columns only are absent; ``confidence`` scores them 0.
    """
    frame = scored.groupBy("table_id").agg(
        F.avg(F.col("column_score")).alias("_mean"),
        F.avg(F.when(F.col("column_score") > 0.7, 1.0).otherwise(0.0)).alias("_good"),
        F.count(F.lit(1)).alias("columns_scored"),
    )
    mean, good = F.col("_mean"), F.col("_good")
    score = (
        F.when(good > 0.8, F.least(F.lit(1.0), mean + 0.1)).when(good > 0.6, mean).otherwise(mean * 0.8)
    )
    grade = F.when(good > 0.8, "High").when(good > 0.6, "Moderate").otherwise("Low")
    # Grades and the text of the reason.
    reason = F.concat(grade, F.lit(" consistency across "), fixed(good * 100, 1), F.lit("% of columns"))
    return frame.select(
        "table_id",
        "columns_scored",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("consistency_score"),
        reason.alias("consistency_reason"),
    )
