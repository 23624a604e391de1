"""The table judge: density, header and consistency scores in one decision.

Cost at scale: one pass over all cells for the column profile (small partial
sums), one pass over the unsettled text columns for exact distinct counts, and
the first rows of each table.  Rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.functions import fixed
from gridsift.operators.consistency import column_consistency, needs_distinct, table_consistency
from gridsift.operators.density import density_score
from gridsift.operators.grid import GridSource, corpus_grid, head_rows
from gridsift.operators.headers import EARLY_VALUES, best_header_row, header_quality, header_rows, score_cells
from gridsift.operators.profile import column_profile, distinct_counts, first_values, table_profile
from gridsift.session import materialize
from gridsift.settings import ScoreSettings


TOP_ROWS = 20


@dataclass(frozen=True)
class Profile:
    """A grid with its column and table profiles and its first rows, computed once."""

    grid: DataFrame
    columns: DataFrame
    tables: DataFrame
    dense: bool
    sources: tuple[GridSource, ...] = ()

    @cached_property
    def top(self) -> DataFrame:
        """The first rows of every table, ranked."""
        return materialize(head_rows(self.grid, TOP_ROWS, self.dense, self.sources))

    def early(self, columns: DataFrame) -> DataFrame:
        """The first values of the given columns, as ``first_values`` has them."""
        return first_values(self.grid, EARLY_VALUES, columns, self.top, self.sources)

    def distinct(self, wanted: DataFrame) -> DataFrame:
        """Numbers of distinct values of the wanted columns."""
        return distinct_counts(self.grid, wanted, self.sources)


def profile(grid: DataFrame | Sequence[GridSource]) -> Profile:
    """Run the profile pass and keep its small result.

    Given sources instead of a grid, later passes scan only the columns they need.
    """
    sources = () if isinstance(grid, DataFrame) else tuple(grid)
    frame = corpus_grid(sources) if sources else grid
    columns = materialize(column_profile(frame))
    dense = bool(sources) and all(s.dense for s in sources)
    return Profile(frame, columns, table_profile(columns), dense, sources)


def gate_reason(settings: ScoreSettings, rows: Column, columns: Column) -> Column:
    """Why a table is not scored at all, else null (fixed values: the texts)."""
    return (
        F.when(F.coalesce(rows, F.lit(0)) == 0, F.lit("Worksheet is empty"))
        .when(
            rows < settings.min_rows,
            F.concat(F.lit("Too few rows: "), rows.cast("string"), F.lit(f" < {settings.min_rows}")),
        )
        .when(
            columns < settings.min_columns,
            F.concat(F.lit("Too few columns: "), columns.cast("string"), F.lit(f" < {settings.min_columns}")),
        )
    )


def gate(tables: DataFrame, settings: ScoreSettings = ScoreSettings()) -> DataFrame:
    """Size check before scoring; ``gate_reason`` is null for tables that pass."""
    return tables.select(
        "table_id", "rows", "columns",
        gate_reason(settings, F.col("rows"), F.col("columns")).alias("gate_reason"),
    )


def confidence(
    grid: DataFrame | Profile | Sequence[GridSource],
    settings: ScoreSettings = ScoreSettings(),
    listed: DataFrame | None = None,
) -> DataFrame:
    """Judge every table of a grid.

    One row per table: component scores, overall score, decision and reasons.
    ``listed`` may name tables (``table_id``) that have no rows; they are judged
    empty.
    """
    known = grid if isinstance(grid, Profile) else profile(grid)
    shapes = known.tables.select("table_id", "rows", "columns")
    if listed is not None:
        shapes = listed.select("table_id").distinct().join(shapes, "table_id", "full")
    checked = gate(shapes, settings)
    passed = checked.where(F.col("gate_reason").isNull()).select("table_id")
    columns = known.columns.join(passed, "table_id", "left_semi")

    headers = header_quality(best_header_row(header_rows(score_cells(known.early(columns), known.top))))
    counts = known.distinct(needs_distinct(columns))
    scores = table_consistency(column_consistency(columns.join(counts, ["table_id", "col_idx"], "left")))
    density = density_score(known.tables, settings.max_empty)

    frame = (
        checked.join(density, "table_id", "left")
        .join(headers, "table_id", "left")
        .join(scores, "table_id", "left")
    )
    passes = F.col("gate_reason").isNull()

    def part(name: str) -> Column:
        return F.when(passes, F.coalesce(name, F.lit(0.0))).otherwise(F.lit(0.0))

    overall = (
        part("density_score") * settings.density_weight
        + part("header_score") * settings.header_weight
        + part("consistency_score") * settings.consistency_weight
    )
    told = F.concat(
        F.col("density_reasons"),
        F.array("header_reason"),
        F.array(F.coalesce("consistency_reason", F.lit("No data columns to analyze"))),
    )
    reasons = F.when(passes, F.array_distinct(F.array_compact(told))).otherwise(F.array("gate_reason"))
    return frame.select(
        "table_id",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("columns", F.lit(0)).alias("columns"),
        part("density_score").alias("density_score"),
        part("header_score").alias("header_score"),
        part("consistency_score").alias("consistency_score"),
        overall.alias("overall"),
        # Rounding guards the limit against the last binary digit of the weighted sum.
        (F.round(overall, 12) >= settings.threshold).alias("accepted"),
        F.coalesce(passes & F.col("has_headers"), F.lit(False)).alias("has_headers"),
        F.when(passes, F.col("header_row")).alias("header_row"),
        reasons.alias("reasons"),
    )


def accepted(scores: DataFrame, threshold: float | None = None) -> DataFrame:
    """Tables that pass, by their own decision or another threshold."""
    if threshold is None:
        return scores.where(F.col("accepted"))
    return scores.where(F.round("overall", 12) >= threshold)


def top_reasons(scores: DataFrame, n: int = 3) -> DataFrame:
    return scores.select("table_id", F.slice("reasons", 1, n).alias("reasons"))


def preview_report(known: Profile, scores: DataFrame, rows: int = 10) -> DataFrame:
    """What a dry run shows per table: size, density, decision, first reasons.

    Accepted tables also show their first rows, at most five.
    """
    shown = min(rows, 5)
    lines = known.top.where(F.col("rank") < shown).groupBy("table_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "cells"))), lambda r: r["cells"]).alias("_rows")
    )
    density = known.tables.select("table_id", (F.col("filled") / (F.col("rows") * F.col("columns"))).alias("density"))
    frame = scores.join(density, "table_id", "left").join(lines, "table_id", "left")
    return frame.select(
        "table_id", "rows", "columns",
        F.coalesce("density", F.lit(0.0)).alias("density"),
        "overall",
        F.when(F.col("accepted"), "ACCEPT").otherwise("REJECT").alias("decision"),
        F.slice("reasons", 1, 3).alias("reasons"),
        F.when(F.col("accepted"), F.col("_rows")).alias("preview"),
    )


def summary_text(scores: DataFrame) -> DataFrame:
    """A readable report per table."""

    def line(label: str, name: str) -> Column:
        return F.concat(F.lit(label), fixed(F.col(name), 3))

    listed = F.when(
        F.size("reasons") > 0,
        F.concat(F.lit("\nReasons:\n  - "), F.array_join("reasons", "\n  - "), F.lit("\n")),
    ).otherwise(F.lit(""))
    verdict = F.when(F.col("accepted"), "ACCEPT").otherwise("REJECT")
    # The labels of the report.
    text = F.concat(
        line("Overall Confidence: ", "overall"),
        line("\n  Data Density: ", "density_score"),
        line("\n  Header Quality: ", "header_score"),
        line("\n  Data Consistency: ", "consistency_score"),
        F.lit("\n"), listed, F.lit("\nDecision: "), verdict,
    )
    return scores.select("table_id", text.alias("summary"))


def out_of_range(scores: DataFrame) -> DataFrame:
    """Rows that break the rule that every score lies in [0, 1]; should be empty."""
    names = ("overall", "density_score", "header_score", "consistency_score")
    wrong = F.lit(False)
    for name in names:
        wrong = wrong | ~F.col(name).between(0.0, 1.0)
    return scores.where(wrong)
