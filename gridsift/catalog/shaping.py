"""Queries on shapes, profiles and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.catalog import query
from gridsift.catalog import sql as Q
from gridsift.catalog.corpora import DIRTY, SHEETS, grid_of, sources_of
from gridsift.operators import grid as G
from gridsift.operators import profile as P
from gridsift.operators.confidence import profile

# All worksheets, cell by cell; results hold digests of the texts.
CELLS = SHEETS + DIRTY
# Rows are put together again by position, which repeats in lineitem.
PLACED = tuple(s for s in CELLS if s.table != "lineitem")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"""
SELECT {", ".join(
    f"CASE WHEN {e} IN ('', '#N/A', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN NULL ELSE {e} END AS {n}"
    for n, e in [
        ("o_orderkey", "cast(o_orderkey as varchar)"), ("o_custkey", "cast(o_custkey as varchar)"),
        ("o_orderstatus", "o_orderstatus"), ("o_totalprice", "cast(cast(o_totalprice as decimal(18,2)) as varchar)"),
        ("o_orderdate", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"), ("o_orderpriority", "o_orderpriority"),
    ])}
FROM orders""")
def scan_raw(spark, sf_dir):
    """All columns as untyped text."""
    return G.scan_raw(_table(spark, sf_dir, "orders"), double_scale=2)


@query(Q.with_corpus(SHEETS, query="""
SELECT table_id, count(DISTINCT rank) AS max_row, max(col_idx) + 1 AS max_column FROM cells GROUP BY table_id"""))
def list_tables(spark, sf_dir):
    return G.list_tables(grid_of(spark, sf_dir, SHEETS))


@query(Q.with_corpus(SHEETS + DIRTY, query="""
SELECT table_id, count(*) AS max_row, max(len(cells)) AS max_column FROM grid GROUP BY table_id"""))
def union_tables(spark, sf_dir):
    """Two corpora of different widths as one."""
    both = G.union_tables([grid_of(spark, sf_dir, SHEETS), grid_of(spark, sf_dir, DIRTY)])
    return G.list_tables(both)


@query(Q.with_corpus(DIRTY, query="""
SELECT table_id, rank, array_to_string(list_transform(cells, lambda c: coalesce(c, '~')), '|') AS row_text
FROM grid WHERE rank < 5"""))
def preview_head(spark, sf_dir):
    """The first rows of every worksheet."""
    sources = sources_of(spark, sf_dir, DIRTY)
    rows = G.preview(G.corpus_grid(sources), 5, sources=sources)
    return rows.select("table_id", "rank", F.array_join("cells", "|", "~").alias("row_text"))


@query("""
SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10""")
def head(spark, sf_dir):
    """The first rows of one frame by key."""
    part = _table(spark, sf_dir, "part").withColumn("_down", -F.col("p_retailprice"))
    return G.head(part, ["_down", "p_partkey"], 10).select("p_partkey", "p_name", "p_brand")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) < 858993459""")
def sample_rows(spark, sf_dir):
    """A reproducible fifth of the rows."""
    return G.sample_rows(_table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber")


@query(Q.with_corpus(CELLS, query="SELECT table_id, row_idx, col_idx, md5(value) AS value_md5 FROM cells"))
def to_cells(spark, sf_dir):
    cells = G.to_cells(grid_of(spark, sf_dir, CELLS))
    return cells.select("table_id", "row_idx", "col_idx", F.md5(F.col("value").cast("binary")).alias("value_md5"))


WIDEST = max(len(s.columns) for s in PLACED)


@query(Q.with_corpus(PLACED, query=f"""
SELECT table_id, row_idx, {", ".join(f"md5(cells[{i + 1}]) AS c{i}" for i in range(WIDEST))} FROM grid"""))
def to_wide(spark, sf_dir):
    """Long cells back to one column per position."""
    cells = G.to_cells(grid_of(spark, sf_dir, PLACED))
    return G.to_wide(cells.withColumn("value", F.md5(F.col("value").cast("binary"))), WIDEST)


@query(Q.with_corpus(PLACED, query="""
SELECT table_id, row_idx, len(cells) AS width, len(list_filter(cells, lambda c: c IS NOT NULL)) AS filled,
  md5(array_to_string(list_transform(cells, lambda c: coalesce(c, '~')), '|')) AS row_md5 FROM grid"""))
def from_cells(spark, sf_dir):
    """Long cells back to grid rows."""
    rows = G.from_cells(G.to_cells(grid_of(spark, sf_dir, PLACED)))
    return rows.select(
        "table_id", "row_idx", F.size("cells").alias("width"), "filled",
        F.md5(F.array_join("cells", "|", "~").cast("binary")).alias("row_md5"),
    )


@query(Q.with_corpus(DIRTY, query="""
SELECT table_id, count(*) AS kept_rows FROM grid
WHERE len(list_filter(cells, lambda c: c IS NOT NULL)) > 0 GROUP BY table_id"""))
def drop_empty_rows(spark, sf_dir):
    """Rows that hold a value, per worksheet."""
    return G.drop_empty_rows(grid_of(spark, sf_dir, DIRTY)).groupBy("table_id").agg(
        F.count(F.lit(1)).alias("kept_rows")
    )


@query(Q.with_corpus(CELLS, Q.TABLES, query="""
SELECT table_id, nrows AS "rows", ncols AS "columns", nrows * ncols AS total_cells,
  CAST(filled AS BIGINT) AS non_empty_cells, CAST(nrows * ncols - filled AS BIGINT) AS empty_cells,
  round(CAST(filled AS DOUBLE) / (nrows * ncols), 6) AS density FROM tabs"""))
def table_shape(spark, sf_dir):
    tables = P.table_counts(grid_of(spark, sf_dir, CELLS))
    return P.shape(tables).withColumn("density", F.round("density", 6))


@query(Q.with_corpus(DIRTY, Q.TABLES, query="""
SELECT table_id, nrows - rows_any AS empty_rows, rows_full AS full_rows, rows_any - rows_full AS partial_rows FROM tabs"""))
def row_fullness(spark, sf_dir):
    return P.row_fullness(P.table_counts(grid_of(spark, sf_dir, DIRTY)))


@query(Q.with_corpus(DIRTY, Q.TABLES, query="""
SELECT table_id, ncols - cols_any AS empty_columns, cols_full AS full_columns, cols_any - cols_full AS partial_columns
FROM tabs"""))
def column_fullness(spark, sf_dir):
    return P.column_fullness(P.column_totals(P.column_counts(sources_of(spark, sf_dir, DIRTY))))


@query(Q.with_corpus(DIRTY, query="""
SELECT table_id, col_idx, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL"""))
def value_freq(spark, sf_dir):
    return P.value_freq(grid_of(spark, sf_dir, DIRTY))


@query(Q.with_corpus(CELLS, query="""
SELECT table_id, col_idx, count(DISTINCT value) AS distinct_values FROM cells
GROUP BY table_id, col_idx HAVING count(value) > 0"""))
def distinct_counts(spark, sf_dir):
    """Exact distinct values of every column, whole texts included."""
    known = profile(sources_of(spark, sf_dir, CELLS))
    return P.distinct_counts(known.grid, known.columns.select("table_id", "col_idx"), known.sources)


@query(Q.with_corpus(DIRTY, query="""
SELECT table_id, col_idx, true AS close FROM cells GROUP BY table_id, col_idx HAVING count(value) > 0"""))
def approx_distinct_counts(spark, sf_dir):
    """Sketched distinct values of every column: within three standard errors (or one value) of the exact ones."""
    known = profile(sources_of(spark, sf_dir, DIRTY))
    wanted, rsd = known.columns.select("table_id", "col_idx"), 0.02
    sketched = P.approx_distinct_counts(known.grid, wanted, rsd).withColumnRenamed("distinct_values", "sketched")
    both = sketched.join(P.distinct_counts(known.grid, wanted, known.sources), ["table_id", "col_idx"])
    off = F.abs(F.col("sketched") - F.col("distinct_values"))
    return both.select("table_id", "col_idx", (off <= F.greatest(F.lit(1.0), 3 * rsd * F.col("distinct_values"))).alias("close"))


_NTH = """nth_values AS (
  SELECT table_id, col_idx, rank, value, row_number() OVER (PARTITION BY table_id, col_idx ORDER BY rank) AS nth
  FROM cells WHERE value IS NOT NULL
)"""


@query(Q.with_corpus(CELLS, _NTH, query="SELECT table_id, col_idx, nth, value FROM nth_values WHERE nth <= 10"))
def first_values(spark, sf_dir):
    """The first ten values of every column, however far down they are."""
    known = profile(sources_of(spark, sf_dir, CELLS))
    return P.first_values(known.grid, 10, known.columns, known.top, known.sources).select("table_id", "col_idx", "nth", "value")


_KINDS = f"""kinds AS (
  SELECT table_id, col_idx, CASE WHEN bool_and({Q.is_number('value')}) THEN 'numeric'
    WHEN bool_and({Q.is_date('value')}) THEN 'date' ELSE 'text' END AS kind
  FROM nth_values WHERE nth <= 100 GROUP BY table_id, col_idx
)"""


def _types(spark, sf_dir):
    known = profile(sources_of(spark, sf_dir, CELLS))
    return P.detect_types(known.grid, known.columns, known.dense, known.sources)


@query(Q.with_corpus(CELLS, _NTH, _KINDS, query="SELECT * FROM kinds"))
def detect_types(spark, sf_dir):
    return _types(spark, sf_dir)


def _listed(kind: str) -> str:
    return f"coalesce(string_agg(CAST(col_idx AS VARCHAR), ',' ORDER BY col_idx) FILTER (WHERE kind = '{kind}'), '')"


@query(Q.with_corpus(CELLS, _NTH, _KINDS, query=f"""
SELECT table_id, {_listed('numeric')} AS numeric_columns, {_listed('date')} AS date_columns, {_listed('text')} AS text_columns,
  count(*) FILTER (WHERE kind = 'numeric') AS numeric_count, count(*) FILTER (WHERE kind = 'date') AS date_count,
  count(*) FILTER (WHERE kind = 'text') AS text_count FROM kinds GROUP BY table_id"""))
def type_census(spark, sf_dir):
    lists = P.type_census(_types(spark, sf_dir))
    for kind in ("numeric", "date", "text"):
        lists = lists.withColumn(f"{kind}_columns", F.array_join(F.col(f"{kind}_columns").cast("array<string>"), ","))
        lists = lists.withColumn(f"{kind}_count", F.col(f"{kind}_count").cast("long"))
    return lists


@query(Q.with_corpus(CELLS, _NTH, _KINDS, query="""
SELECT table_id, string_agg(col_idx || '=' || kind, ',' ORDER BY CAST(col_idx AS VARCHAR)) AS column_types
FROM kinds GROUP BY table_id"""))
def column_types(spark, sf_dir):
    types = P.column_types(_types(spark, sf_dir))
    pairs = F.transform(
        F.array_sort(F.map_entries("column_types")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return types.select("table_id", F.array_join(pairs, ",").alias("column_types"))


@query(Q.with_corpus(DIRTY, query=f"""
SELECT table_id, round(avg(CASE WHEN value IS NOT NULL AND {Q.strip('value')} <> '' THEN 1e0 ELSE 0e0 END), 6) AS first_row_text_ratio,
  CASE WHEN avg(CASE WHEN value IS NOT NULL AND {Q.strip('value')} <> '' THEN 1e0 ELSE 0e0 END) > 5e-1 THEN 0 END AS potential_header_row
FROM cells WHERE rank = 0 GROUP BY table_id"""))
def potential_header_row(spark, sf_dir):
    top = P.potential_header(profile(sources_of(spark, sf_dir, DIRTY)).top)
    return top.withColumn("first_row_text_ratio", F.round("first_row_text_ratio", 6))


@query(Q.with_corpus(SHEETS, Q.TABLES, query="""
SELECT table_id, nrows * ncols * 10 + ncols * 20 AS estimated_bytes FROM tabs"""))
def size_estimate(spark, sf_dir):
    return P.estimate_size(P.table_counts(grid_of(spark, sf_dir, SHEETS)))


_SPENT = "CASE event_type WHEN 'view' THEN 'customer' WHEN 'click' THEN 'orders' WHEN 'error' THEN 'part' ELSE 'events' END"


@query(Q.with_corpus(DIRTY, Q.TABLES, query=f"""
SELECT t.source, total_rows, total_columns, tables, tables_with_data, success_rate,
  round(coalesce(total_rows / spent * 1000, 0e0), 4) AS rows_per_second
FROM (
  SELECT regexp_extract(table_id, '^[a-z]+') AS source, CAST(sum(nrows) AS BIGINT) AS total_rows,
    CAST(sum(ncols) AS BIGINT) AS total_columns, count(*) AS tables, count(*) FILTER (WHERE rows_any > 0) AS tables_with_data,
    round(CAST(count(*) FILTER (WHERE rows_any > 0) AS DOUBLE) / count(*), 6) AS success_rate
  FROM tabs GROUP BY 1
) t LEFT JOIN (SELECT {_SPENT} AS source, sum(value) AS spent FROM events GROUP BY 1) e ON e.source = t.source"""))
def run_totals(spark, sf_dir):
    """Rows, columns, worksheets and speed per source."""
    tables = P.table_counts(grid_of(spark, sf_dir, DIRTY))
    spent = _table(spark, sf_dir, "events").select(F.expr(_SPENT).alias("source"), F.col("value").alias("duration_ms"))
    totals = P.run_totals(tables, F.regexp_extract("table_id", "^[a-z]+", 0), durations=spent)
    return totals.withColumn("success_rate", F.round("success_rate", 6)).withColumn(
        "rows_per_second", F.round("rows_per_second", 4)
    )
