"""Column and table profiles: one pass over the cells, no shuffle of rows.

``column_profile`` is the frame everything else is derived from.  It has one row
per column of every table and is small, so callers compute it once and keep it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsift.functions import is_date, is_number, strip
from gridsift.operators.grid import GridSource, head_rows, narrow_grid, to_cells, union_tables
from gridsift.plans import join_small
from gridsift.session import materialize

TYPE_SAMPLE = 100


def _count_if(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")


def column_profile(grid: DataFrame) -> DataFrame:
    """Counts per column; row measures ride along on the first column.

    Grouped by ``(table_id, col_idx)`` with map-side partial sums: each task emits
    one row per column it saw, whatever the table sizes are.
    """
    # The outer form: the plain one adds a filter that builds every cell twice.
    rows = grid.select("table_id", "row_idx", "filled", F.size("cells").alias("width"), "cells")
    cells = rows.select(
        "table_id", "row_idx", "filled", "width", F.posexplode_outer("cells").alias("col_idx", "value")
    ).where(F.col("col_idx").isNotNull())
    value, filled = F.col("value"), F.col("filled")
    first = F.col("col_idx") == 0
    size = F.length(value)
    return cells.groupBy("table_id", "col_idx").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("n"),
        _count_if(is_number(value)).alias("numbers"),
        _count_if(is_date(value)).alias("dates"),
        F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("length"),
        F.coalesce(F.sum(size.cast("double") * size), F.lit(0.0)).alias("length2"),
        _count_if(first & (filled > 0)).alias("rows_any"),
        _count_if(first & (filled == F.col("width"))).alias("rows_full"),
        F.coalesce(F.sum(F.when(first, filled.cast("double") * filled)), F.lit(0.0)).alias("filled2"),
        F.max("row_idx").alias("last_position"),
    )


def table_profile(columns: DataFrame) -> DataFrame:
    """Shape and fullness per table, from the column profile."""
    return columns.groupBy("table_id").agg(
        F.max("rows").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.sum("n").alias("filled"),
        F.sum("rows_any").alias("rows_any"),
        F.sum("rows_full").alias("rows_full"),
        F.sum("filled2").alias("filled2"),
        _count_if(F.col("n") > 0).alias("columns_any"),
        _count_if(F.col("n") == F.col("rows")).alias("columns_full"),
        F.max("last_position").alias("last_position"),
    )


def table_counts(grid: DataFrame) -> DataFrame:
    """The shape of every table and the fullness of its rows, from row measures alone: no cell is looked at."""
    filled, width = F.col("filled"), F.size("cells")
    return grid.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(width).cast("long").alias("columns"),
        F.sum(filled.cast("long")).alias("filled"),
        _count_if(filled > 0).alias("rows_any"),
        _count_if(filled == width).alias("rows_full"),
    )


def column_counts(sources: Sequence[GridSource]) -> DataFrame:
    """Rows and filled cells per column, from one wide aggregate for each source: cells are not spread out."""
    parts = []
    for source in sources:
        width = len(source.columns or source.df.columns)
        counts = F.array(*[F.count(F.get("cells", F.lit(i))) for i in range(width)])
        table = source.grid().groupBy("table_id").agg(F.count(F.lit(1)).alias("rows"), counts.alias("counts"))
        parts.append(table.select("table_id", "rows", F.posexplode("counts").alias("col_idx", "n")))
    return union_tables(parts)


def column_totals(columns: DataFrame) -> DataFrame:
    """Number of columns, of those with a value and of full ones per table, from ``column_counts``."""
    return columns.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("columns"),
        _count_if(F.col("n") > 0).alias("columns_any"),
        _count_if(F.col("n") == F.col("rows")).alias("columns_full"),
    )


def shape(tables: DataFrame) -> DataFrame:
    """Rows, columns, cells and density of every table."""
    cells = F.col("rows") * F.col("columns")
    return tables.select(
        "table_id", "rows", "columns",
        cells.alias("total_cells"),
        F.col("filled").alias("non_empty_cells"),
        (cells - F.col("filled")).alias("empty_cells"),
        F.coalesce(F.col("filled") / F.nullif(cells, F.lit(0)), F.lit(0.0)).alias("density"),
    )


def row_fullness(tables: DataFrame) -> DataFrame:
    """Empty, full and partly filled rows."""
    empty = F.col("rows") - F.col("rows_any")
    return tables.select(
        "table_id",
        empty.alias("empty_rows"),
        F.col("rows_full").alias("full_rows"),
        (F.col("rows") - empty - F.col("rows_full")).alias("partial_rows"),
    )


def column_fullness(tables: DataFrame) -> DataFrame:
    """Empty, full and partly filled columns."""
    empty = F.col("columns") - F.col("columns_any")
    return tables.select(
        "table_id",
        empty.alias("empty_columns"),
        F.col("columns_full").alias("full_columns"),
        (F.col("columns") - empty - F.col("columns_full")).alias("partial_columns"),
    )


def value_freq(grid: DataFrame) -> DataFrame:
    """How often each value occurs in each column."""
    return to_cells(grid, keep_empty=False).groupBy("table_id", "col_idx", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def value_key(value: Column) -> Column:
    """The value itself, or a SHA-256 of it when it is longer than the digest.

    The two never coincide: a digest key is 65 characters long.
    """
    return F.when(F.length(value) <= 64, value).otherwise(F.concat(F.lit("#"), F.sha2(value, 256)))


def distinct_counts(
    grid: DataFrame, wanted: DataFrame, sources: Sequence[GridSource] = ()
) -> DataFrame:
    """Exact number of distinct values of the wanted ``(table_id, col_idx)`` columns.

    Only cells of wanted columns are shuffled, once per distinct value and task,
    and long texts travel as digests.  With ``sources`` only those columns are
    scanned.
    """
    if sources:
        wanted = materialize(wanted)
        grid = narrow_grid(sources, wanted)
        if grid is None:
            return wanted.select("table_id", "col_idx", F.lit(0).cast("long").alias("distinct_values"))
    needed = wanted.groupBy("table_id").agg(F.collect_set("col_idx").alias("_wanted"))
    cells = _wanted_cells(grid, needed)
    keys = cells.select("table_id", "col_idx", value_key(F.col("value")).alias("_key")).distinct()
    return keys.groupBy("table_id", "col_idx").agg(F.count(F.lit(1)).alias("distinct_values"))


def _wanted_cells(grid: DataFrame, needed: DataFrame) -> DataFrame:
    joined = join_small(grid.select("table_id", "cells"), needed, ["table_id"])
    cells = joined.select("table_id", "_wanted", F.posexplode_outer("cells").alias("col_idx", "value"))
    return cells.where(F.col("value").isNotNull() & F.array_contains("_wanted", F.col("col_idx")))


def approx_distinct_counts(grid: DataFrame, wanted: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Sketch-based form of ``distinct_counts`` for very many distinct values (opt-in)."""
    needed = wanted.groupBy("table_id").agg(F.collect_set("col_idx").alias("_wanted"))
    return _wanted_cells(grid, needed).groupBy("table_id", "col_idx").agg(
        F.approx_count_distinct("value", rsd).alias("distinct_values")
    )


def first_values(
    grid: DataFrame, k: int, columns: DataFrame, top: DataFrame, sources: Sequence[GridSource] = (), positions: bool = False
) -> DataFrame:
    """The first k non-null values of every column.

    ``top`` holds the first rows of each table (``head_rows``).  Only columns that
    have more values but not k of them up there are searched in the whole table;
    with ``sources`` only those columns are scanned.
    Returns ``table_id, col_idx, nth (1-based), rank, value``; ``rank`` is the row
    number for rows of ``top`` and a large number beyond.  With ``positions`` also ``row_idx``.
    """
    extra = [] if positions else ["row_idx"]
    cells = top.select(
        "table_id", "row_idx", "rank", F.posexplode_outer("cells").alias("col_idx", "value")
    ).where(F.col("value").isNotNull())
    by_rank = Window.partitionBy("table_id", "col_idx").orderBy("rank", "row_idx", "value")
    found = cells.withColumn("nth", F.row_number().over(by_rank)).where(F.col("nth") <= k)
    found = found.select("table_id", "col_idx", "nth", "rank", "row_idx", "value")
    counts = cells.groupBy("table_id", "col_idx").agg(F.count(F.lit(1)).alias("_found"))
    short = (
        columns.select("table_id", "col_idx", "n")
        .join(counts, ["table_id", "col_idx"], "left")
        .where(F.coalesce("_found", F.lit(0)) < F.least(F.lit(k), F.col("n")))
        .groupBy("table_id").agg(F.collect_set("col_idx").alias("_wanted"))
    )
    short = materialize(short)
    if short.isEmpty():
        return found.drop(*extra)
    if sources:
        grid = narrow_grid(sources, short.select("table_id", F.explode("_wanted").alias("col_idx")))
    # Where positions repeat, the last one on top may have more rows: it is searched again as a whole.
    cut = top.groupBy("table_id").agg(F.max("row_idx").alias("_cut"))
    again = short.join(cut, "table_id").select("table_id", F.explode("_wanted").alias("col_idx"), "_cut")
    found = found.join(again, ["table_id", "col_idx"], "left").where("_cut IS NULL OR row_idx < _cut").drop("_cut")
    rest = join_small(grid.select("table_id", "row_idx", "cells"), short.join(cut, "table_id"), ["table_id"])
    rest = rest.where(F.col("row_idx") >= F.col("_cut"))
    rest = rest.select(
        "table_id", "row_idx", "_wanted", F.posexplode_outer("cells").alias("col_idx", "value"),
        F.pmod(F.spark_partition_id(), F.lit(256)).alias("_salt"),
    ).where(F.col("value").isNotNull() & F.array_contains("_wanted", F.col("col_idx")))
    salted = Window.partitionBy("table_id", "col_idx", "_salt").orderBy("row_idx", "value")
    rest = rest.withColumn("nth", F.row_number().over(salted)).where(F.col("nth") <= k)
    rest = rest.select(
        "table_id", "col_idx", F.lit(0).alias("nth"), F.lit(2**31 - 1).alias("rank"), "row_idx", "value"
    )
    return (
        found.unionByName(rest)
        .withColumn("nth", F.row_number().over(by_rank))
        .where(F.col("nth") <= k)
        .drop(*extra)
    )


def detect_types(
    grid: DataFrame, columns: DataFrame, dense: bool = False, sources: Sequence[GridSource] = ()
) -> DataFrame:
    """Per column: numeric, date or text, by its first 100 values; empty columns have no type."""
    top = materialize(head_rows(grid, 2 * TYPE_SAMPLE, dense, sources))
    sample = first_values(grid, TYPE_SAMPLE, columns, top, sources)
    judged = sample.groupBy("table_id", "col_idx").agg(
        F.bool_and(is_number(F.col("value"))).alias("_all_numbers"),
        F.bool_and(is_date(F.col("value"))).alias("_all_dates"),
    )
    kind = F.when(F.col("_all_numbers"), "numeric").when(F.col("_all_dates"), "date").otherwise("text")
    return judged.select("table_id", "col_idx", kind.alias("kind"))


def type_census(types: DataFrame) -> DataFrame:
    """Column lists and counts per kind; a list is as long as the table is wide."""

    def listed(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("col_idx"))))

    lists = types.groupBy("table_id").agg(
        listed("numeric").alias("numeric_columns"),
        listed("date").alias("date_columns"),
        listed("text").alias("text_columns"),
    )
    return lists.select(
        "*",
        F.size("numeric_columns").alias("numeric_count"),
        F.size("date_columns").alias("date_count"),
        F.size("text_columns").alias("text_count"),
    )


def column_types(types: DataFrame) -> DataFrame:
    """Map of column position to kind, one per table."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("col_idx").cast("string").alias("k"), "kind")))
    return types.groupBy("table_id").agg(F.map_from_entries(entries).alias("column_types"))


def potential_header(top: DataFrame) -> DataFrame:
    """Share of text in the first row, and whether that makes it a header (> 0.5)."""
    top = top.where(F.col("rank") == 0)
    texts = F.size(F.filter("cells", lambda c: c.isNotNull() & (strip(c) != "")))
    share = texts / F.size("cells")
    return top.select(
        "table_id",
        share.alias("first_row_text_ratio"),
        F.when(share > 0.5, F.lit(0)).alias("potential_header_row"),
    )


def estimate_size(tables: DataFrame) -> DataFrame:
    """Bytes of the delivered file: 10 per cell and 20 per column name."""
    size = F.col("rows") * F.col("columns") * 10 + F.col("columns") * 20
    return tables.select("table_id", size.alias("estimated_bytes"))


def run_totals(
    tables: DataFrame, source: Column, listed: DataFrame | None = None, durations: DataFrame | None = None
) -> DataFrame:
    """Totals per source: rows, columns, tables, and share of listed tables that had data.

    ``listed`` names every table the source claims to hold (``source, table_id``).
    ``durations`` gives the time spent per source (``source, duration_ms``) and adds
    the rows read per second, 0 where no time is known.
    """
    totals = tables.withColumn("source", source).groupBy("source").agg(
        F.sum("rows").alias("total_rows"),
        F.sum("columns").alias("total_columns"),
        _count_if(F.col("rows_any") > 0).alias("tables_with_data"),
        F.count(F.lit(1)).alias("_tables"),
    )
    if listed is not None:
        claims = listed.groupBy("source").agg(F.count(F.lit(1)).alias("_listed"))
        totals = claims.join(totals, "source", "left").drop("_tables").withColumnRenamed("_listed", "_tables")
    found = F.coalesce("tables_with_data", F.lit(0))
    out = totals.select(
        "source",
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce("total_columns", F.lit(0)).alias("total_columns"),
        F.col("_tables").alias("tables"),
        found.alias("tables_with_data"),
        (found / F.col("_tables")).alias("success_rate"),
    )
    if durations is None:
        return out
    spent = durations.groupBy("source").agg(F.sum("duration_ms").alias("_ms"))
    rate = F.col("total_rows") / F.nullif(F.col("_ms"), F.lit(0.0)) * 1000
    return out.join(spent, "source", "left").withColumn("rows_per_second", F.coalesce(rate, F.lit(0.0))).drop("_ms")
