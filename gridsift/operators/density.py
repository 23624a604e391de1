"""Density score: how full a table is, and how evenly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.functions import fixed


def _deviation(total: Column, squares: Column, count: Column) -> Column:
    """Sample standard deviation from sums; null for a single value."""
    total, count = total.cast("double"), count.cast("double")
    spread = (squares - total * total / count) / F.nullif(count - 1, F.lit(0.0))
    return F.sqrt(F.greatest(spread, F.lit(0.0)))


def clustering_bonus(tables: DataFrame) -> DataFrame:
    """Bonus for tables whose rows are covered and filled alike (all rows, no sample)."""
    rows, columns = F.col("rows"), F.col("columns")
    coverage = (F.col("rows_any") / rows + F.col("columns_any") / columns) / 2
    deviation = _deviation(F.col("filled"), F.col("filled2"), rows) / columns
    evenness = F.greatest(F.lit(0.0), 1 - F.coalesce(deviation, F.lit(0.0)))
    score = coverage * 0.6 + evenness * 0.4
    bonus = (
        F.when(score > 0.7, F.least(F.lit(0.2), score * 0.25))
        .when(score > 0.5, F.least(F.lit(0.1), score * 0.15))
        .otherwise(F.lit(0.0))
    )
    return tables.select("*", score.alias("clustering_score"), bonus.alias("clustering_bonus"))


def density_score(tables: DataFrame, max_empty: float = 0.3) -> DataFrame:
    """Density component score and its reasons, in order."""
    frame = clustering_bonus(tables)
    rows, columns = F.col("rows"), F.col("columns")
    density = F.col("filled") / (rows * columns)
    empty_rows = (rows - F.col("rows_any")) / rows
    empty_columns = (columns - F.col("columns_any")) / columns
    sparse = density < (1.0 - max_empty)
    good = ~sparse & (density > 0.8)
    middle = ~sparse & ~good

    shrunk = density
    shrunk = F.when(empty_rows > 0.2, shrunk * (1.0 - empty_rows * 0.5)).otherwise(shrunk)
    shrunk = F.when(empty_columns > 0.2, shrunk * (1.0 - empty_columns * 0.5)).otherwise(shrunk)
    raised = F.least(F.lit(1.0), shrunk + F.col("clustering_bonus"))
    score = (
        F.when(sparse, density * 0.5)
        .when(good, F.least(F.lit(1.0), density * 1.2))
        .otherwise(F.greatest(F.lit(0.0), raised))
    )

    def told(text: str, value: Column) -> Column:
        # The texts of the reasons below.
        return F.concat(F.lit(text), fixed(value, 3))

    reasons = F.array(
        F.when(sparse, told("Low data density: ", density)),
        F.when(good, told("Good data density: ", density)),
        F.when(middle & (empty_rows > 0.2), told("Too many empty rows: ", empty_rows)),
        F.when(middle & (empty_columns > 0.2), told("Too many empty columns: ", empty_columns)),
        F.when(middle & (F.col("clustering_bonus") > 0), F.lit("Data shows good clustering pattern")),
    )
    return frame.select(
        "table_id",
        density.alias("density"),
        score.alias("density_score"),
        F.array_compact(reasons).alias("density_reasons"),
    )
