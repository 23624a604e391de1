"""The grid: untyped tables of text, many in one DataFrame.

One row per table row::

    table_id STRING, row_idx LONG, cells ARRAY<STRING>, filled INT

``row_idx`` orders the rows of a table; it need not be dense.  A null cell is
empty.  All rows of a table have the same number of cells.  ``filled`` counts the
non-null cells, so row statistics need no shuffle.  Tables of any width share
this one schema, so a corpus is a plain union.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsift.functions import null_if_token
from gridsift.functions.text import NULL_TOKENS
from gridsift.plans import join_small
from gridsift.session import materialize

GRID_SCHEMA = "table_id string, row_idx bigint, cells array<string>, filled int"
HEADER_POSITION = 0


def count_filled(cells: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cells], F.lit(0))


def cell_text(name: str, kind: T.DataType, double_scale: int | None = None) -> str:
    """The SQL expression of a typed column as cell text (no header, no type kept)."""
    column = "`" + name.replace("`", "``") + "`"
    text = f"CAST({column} AS STRING)"
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.TimestampNTZType):
        return f"substring({text}, 1, 19)"
    if isinstance(kind, T.TimestampType):
        return f"date_format({column}, 'yyyy-MM-dd HH:mm:ss')"
    if isinstance(kind, (T.DoubleType, T.FloatType)) and double_scale is not None:
        # Values that no decimal holds (very large, infinite) keep their own text; not-a-number is empty.
        exact = f"CAST(try_cast({column} AS DECIMAL(18,{double_scale})) AS STRING)"
        return f"coalesce({exact}, CASE WHEN NOT isnan({column}) THEN {text} END)"
    if isinstance(kind, T.BooleanType):
        return f"CASE WHEN {column} THEN 'True' WHEN NOT {column} THEN 'False' END"
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({column})"
    return text


def _literal(text: str | None) -> str:
    """A text as SQL, whatever signs it holds."""
    return "CAST(NULL AS STRING)" if text is None else f"CAST(X'{text.encode().hex()}' AS STRING)"


def _free_name(stem: str, taken: Collection[str]) -> str:
    """A column name that a frame does not have."""
    while stem in {t.lower() for t in taken}:
        stem += "_"
    return stem


def scan_raw(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS, double_scale: int | None = None) -> DataFrame:
    """Every column as text, empty markers as null."""
    return df.select([
        null_if_token(F.expr(cell_text(f.name, f.dataType, double_scale)), tokens).alias(f.name)
        for f in df.schema.fields
    ])


@dataclass(frozen=True)
class GridSource:
    """A wide frame to be read as grid rows, whole or only some of its columns.

    ``table_id`` is a constant name or a column (one table per distinct value).
    ``position`` must be a non-negative integer that orders the rows.  With
    ``header`` the column names (or ``names``) become the first row of every table.
    ``dense`` is the maker's word that the positions of every table are 0, 1, 2 ...
    (1, 2, 3 ... below a header) and never repeat; nothing else can tell.
    """

    df: DataFrame
    table_id: str | Column
    position: str | Column
    columns: tuple[str, ...] = ()
    header: bool = True
    tokens: tuple[str, ...] = NULL_TOKENS
    double_scale: int | None = None
    names: tuple[str | None, ...] = ()
    dense: bool = False

    def grid(self, keep: Collection[int] | None = None, upto: int | None = None) -> DataFrame:
        """Grid rows.  Columns not in ``keep`` stay in place but empty, and are not scanned.

        ``upto`` keeps rows up to a grid position.  It is compared with the position as it
        stands in the frame, so a scan can skip row groups by their statistics.
        """
        fields = {f.name: f.dataType for f in self.df.schema.fields}
        columns = self.columns or tuple(fields)
        name = F.lit(self.table_id) if isinstance(self.table_id, str) else self.table_id
        place = F.expr(self.position) if isinstance(self.position, str) else self.position
        kept = range(len(columns)) if keep is None else sorted(keep)
        rows = self.df if upto is None else self.df.where(place <= upto - (1 if self.header else 0))
        # The cells are said in SQL: a call for each expression of each column takes longer than planning them all.
        table_key, row_key = _free_name("_table_key", fields), _free_name("_row_key", fields)
        texts = rows.select("*", name.alias(table_key), place.cast("long").alias(row_key)).selectExpr(
            f"{table_key} AS table_id",
            f"{row_key} + {1 if self.header else 0} AS row_idx",
            *[f"{cell_text(columns[i], fields[columns[i]], self.double_scale)} AS c{i}" for i in kept],
        )
        listed = ", ".join("'" + t.replace("'", "\\'") + "'" for t in self.tokens)
        raw = texts.selectExpr(
            "table_id", "row_idx",
            *[
                f"CASE WHEN c{i} IN ({listed}) THEN NULL ELSE c{i} END AS c{i}"
                if listed and self._may_be_empty(fields[columns[i]]) else f"c{i}"
                for i in kept
            ],
        )
        cells = ", ".join(f"c{i}" if i in set(kept) else "CAST(NULL AS STRING)" for i in range(len(columns)))
        filled = " + ".join(f"CAST(c{i} IS NOT NULL AS INT)" for i in kept) or "0"
        data = raw.selectExpr("table_id", "row_idx", f"array({cells}) AS cells", f"{filled} AS filled")
        return data.unionByName(self._header_row(columns, kept)) if self.header else data

    def _may_be_empty(self, kind: T.DataType) -> bool:
        """Whether a value of this type can read like an empty marker."""
        plain = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
        scaled = isinstance(kind, T.DecimalType) or (
            self.double_scale is not None and isinstance(kind, (T.DoubleType, T.FloatType))
        )
        return self.tokens != NULL_TOKENS or not (scaled or isinstance(kind, plain))

    def _header_row(self, columns: Sequence[str], kept: Collection[int]) -> DataFrame:
        kept = set(kept)
        names = [
            n if i in kept and n not in self.tokens else None for i, n in enumerate(self.names or columns)
        ]
        if isinstance(self.table_id, str):
            tables = self.df.sparkSession.range(0, 1, 1, 1).select(F.lit(self.table_id).alias("table_id"))
        else:
            tables = self.df.select(self.table_id.alias("table_id")).distinct()
        return tables.selectExpr(
            "table_id",
            f"CAST({HEADER_POSITION} AS BIGINT) AS row_idx",
            f"array({', '.join(map(_literal, names))}) AS cells",
            f"{sum(n is not None for n in names)} AS filled",
        )


def to_grid(
    df: DataFrame,
    table_id: str | Column,
    position: str | Column,
    columns: Sequence[str] = (),
    header: bool = True,
    tokens: Sequence[str] = NULL_TOKENS,
    double_scale: int | None = None,
    names: Sequence[str | None] = (),
) -> DataFrame:
    """A typed or text frame as grid rows; see ``GridSource``."""
    source = GridSource(
        df, table_id, position, tuple(columns), header, tuple(tokens), double_scale, tuple(names)
    )
    return source.grid()


def corpus_grid(sources: Sequence[GridSource]) -> DataFrame:
    """All sources as one grid."""
    return union_tables([source.grid() for source in sources])


def narrow_grid(sources: Sequence[GridSource], wanted: DataFrame) -> DataFrame | None:
    """The corpus with only the columns some table wants (``table_id, col_idx``) scanned.

    The choice is made per source, from at most one row per named table and
    column, plus one per column for sources that hold many tables.
    """
    named = [s.table_id for s in sources if isinstance(s.table_id, str)]
    label = F.when(F.col("table_id").isin(named), F.col("table_id")) if named else F.lit(None).cast("string")
    chosen: dict[str | None, set[int]] = {}
    for row in wanted.select(label.alias("source"), "col_idx").distinct().collect():
        chosen.setdefault(row["source"], set()).add(row["col_idx"])
    grids = []
    for source in sources:
        keep = chosen.get(source.table_id if isinstance(source.table_id, str) else None, set())
        keep = {i for i in keep if i < len(source.columns or source.df.columns)}
        if keep:
            grids.append(source.grid(keep))
    return union_tables(grids) if grids else None


def as_grid(df: DataFrame) -> DataFrame:
    """Complete a frame of ``table_id, row_idx, cells`` to the grid schema."""
    filled = F.size(F.filter("cells", lambda c: c.isNotNull()))
    return df.select("table_id", F.col("row_idx").cast("long").alias("row_idx"), "cells", filled.alias("filled"))


def union_tables(grids: Sequence[DataFrame]) -> DataFrame:
    """Several grids as one corpus."""
    return reduce(DataFrame.unionByName, grids)


def to_cells(grid: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Long form: ``table_id, row_idx, col_idx, value``."""
    cells = grid.select("table_id", "row_idx", F.posexplode_outer("cells").alias("col_idx", "value"))
    cells = cells.where(F.col("col_idx").isNotNull())
    return cells if keep_empty else cells.where(F.col("value").isNotNull())


def from_cells(cells: DataFrame) -> DataFrame:
    """Long form back to grid rows; a row gathers its own cells only."""
    widths = cells.groupBy("table_id").agg((F.max("col_idx") + 1).alias("_width"))
    rows = cells.groupBy("table_id", "row_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("_by_col")
    )
    wide = join_small(rows, widths, ["table_id"]).select(
        "table_id",
        "row_idx",
        F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda i: F.col("_by_col")[i]).alias("cells"),
    )
    return as_grid(wide)


def to_wide(cells: DataFrame, width: int, keys: Sequence[str] = ("table_id", "row_idx")) -> DataFrame:
    """Long form to one column per position ``c0..cN``."""
    picks = [F.max(F.when(F.col("col_idx") == i, F.col("value"))).alias(f"c{i}") for i in range(width)]
    return cells.groupBy(*keys).agg(*picks)


def grid_columns(grid: DataFrame, names: Sequence[str]) -> DataFrame:
    """Grid rows of one table as named columns, without a shuffle."""
    return grid.select(
        "table_id", "row_idx", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]
    )


def drop_empty_rows(grid: DataFrame) -> DataFrame:
    """Rows with at least one value; a table without any disappears ("no data")."""
    return grid.where(F.col("filled") > 0)


def list_tables(grid: DataFrame) -> DataFrame:
    """Number of rows and columns of every table."""
    return grid.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("max_row"), F.max(F.size("cells")).alias("max_column")
    )


def _tie() -> Column:
    return F.array_join("cells", "\x1f", "")


def head_positions(grid: DataFrame, k: int) -> DataFrame:
    """Position of the k-th row of every table (or of its last, if it is shorter).

    Reads only the two key columns.  A first ranking per input partition, spread
    over salts, leaves a few rows per salt, so a huge table is no hot task.
    """
    salted = grid.select("table_id", "row_idx", F.pmod(F.spark_partition_id(), F.lit(256)).alias("_salt"))
    first = Window.partitionBy("table_id", "_salt").orderBy("row_idx")
    final = Window.partitionBy("table_id").orderBy("row_idx")
    kept = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    kept = kept.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= k)
    return kept.groupBy("table_id").agg(F.max("row_idx").alias("last_position"))


def _near(grid: DataFrame, cut: DataFrame, sources: Sequence[GridSource]) -> DataFrame:
    """Rows up to the cut of their table.

    A source of one table is scanned with its cut as a literal on the raw position
    (the driver holds one number per such source); the others are joined with the cuts.
    """
    named = [s.table_id for s in sources if isinstance(s.table_id, str)]
    by_name = {r["table_id"]: r["last_position"] for r in cut.where(F.col("table_id").isin(named)).collect()} if named else {}
    parts = [s.grid(upto=by_name[s.table_id]) for s in sources if isinstance(s.table_id, str) and s.table_id in by_name]
    many = [s.grid() for s in sources if not isinstance(s.table_id, str)] if sources else [grid]
    if many:
        joined = join_small(union_tables(many), cut, ["table_id"])
        parts.append(joined.where(F.col("row_idx") <= F.col("last_position")).drop("last_position"))
    return union_tables(parts) if parts else grid.limit(0)


def head_rows(grid: DataFrame, k: int, dense: bool = False, sources: Sequence[GridSource] = ()) -> DataFrame:
    """The first k rows of every table with their 0-based ``rank``.

    ``dense`` says that positions are 0, 1, 2 ... in every table and never repeat; then
    the rows are found by a plain filter.  Rows that share the k-th position are
    told apart by their cells; each task keeps k of a table before they meet.  With
    ``sources`` (which make up the grid) scans are cut by position.
    """
    near = grid.where(F.col("row_idx") < k) if dense else _near(grid, materialize(head_positions(grid, k)), sources)
    salted = near.withColumn("_tie", _tie()).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(256)))
    first = Window.partitionBy("table_id", "_salt").orderBy("row_idx", "_tie")
    few = salted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    place = Window.partitionBy("table_id").orderBy("row_idx", "_tie")
    ranked = few.withColumn("rank", F.row_number().over(place) - 1).where(F.col("rank") < k)
    return ranked.drop("_tie", "_salt")


def preview(grid: DataFrame, n: int = 10, dense: bool = False, sources: Sequence[GridSource] = ()) -> DataFrame:
    """The first n rows of every table; with ``sources`` (which make up the grid) scans are cut by position."""
    return head_rows(grid, n, dense, sources).where(F.col("rank") < n)


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of one frame by key; one top-n, no full sort."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """A reproducible share of the rows, picked by the MD5 of the key's text (a null key counts as empty)."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    bucket = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return df.where(bucket < int(round(share * 2**32)))
