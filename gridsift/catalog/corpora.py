"""The corpora the registered queries read, for Spark and as SQL.

``sheets`` turns the flat tables into one worksheet each.  ``dirty`` splits tables
into many worksheets by a column and blanks or garbles some of their cells.  Both
cover all rows of the tables they use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.operators.grid import GridSource, corpus_grid


@dataclass(frozen=True)
class Column:
    """A worksheet column: header, expression (both engines), kind of text.

    Kinds: ``s`` text, ``i`` whole number, ``d`` two decimals, ``t`` time stamp,
    ``us`` month/day/year, ``long`` like ``Jan 5, 2024``.
    """

    header: str
    expr: str
    kind: str = "s"


@dataclass(frozen=True)
class Sheet:
    table: str
    table_id: str
    position: str
    columns: tuple[Column, ...]
    header: bool = True


def _flat(table: str, position: str, columns: str) -> Sheet:
    parsed = []
    for item in columns.split():
        name, _, kind = item.partition(":")
        parsed.append(Column(name, name, kind or "s"))
    return Sheet(table, f"'{table}'", position, tuple(parsed))


SHEETS = (
    _flat("region", "r_regionkey", "r_regionkey:i r_name"),
    _flat("nation", "n_nationkey", "n_nationkey:i n_name n_regionkey:i"),
    _flat("customer", "c_custkey", "c_custkey:i c_name c_nationkey:i c_acctbal:d c_mktsegment"),
    _flat("supplier", "s_suppkey", "s_suppkey:i s_name s_nationkey:i s_acctbal:d"),
    _flat("part", "p_partkey", "p_partkey:i p_name p_brand p_type p_size:i p_retailprice:d"),
    _flat(
        "orders", "o_orderkey",
        "o_orderkey:i o_custkey:i o_orderstatus o_totalprice:d o_orderdate:t o_orderpriority",
    ),
    _flat(
        "lineitem", "l_orderkey * 8 + l_linenumber",
        "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d "
        "l_tax:d l_returnflag l_linestatus l_shipdate:t",
    ),
    _flat("events", "event_id", "event_id:i ts:t user_id:i event_type value:d props"),
    _flat("documents", "doc_id", "doc_id:i text lang source n_chars:i"),
    _flat("pages", "page_id", "page_id:i url html"),
    _flat("benchmark", "item_id", "item_id:i text"),
    _flat("labels", "doc_id", "doc_id:i quality:i toxic:i"),
    _flat("conversations", "conv_id * 1000 + turn", "conv_id:i turn:i role text"),
)

_NOTHING = "cast(null as string)"

DIRTY = (
    # Blanks here and there and an unnamed empty column: density between 0.7 and 0.8.
    Sheet("customer", "concat('customer_', cast(c_nationkey as string))", "c_custkey", (
        Column("Customer ID", "c_custkey", "i"),
        Column("Name", "case when c_custkey % 3 = 0 then null else c_name end"),
        Column("Nation code", "c_nationkey", "i"),
        Column("Amount", "case when c_custkey % 4 = 1 then null else c_acctbal end", "d"),
        Column("Segment", "c_mktsegment"),
        Column("", _NOTHING),
    )),
    # Every fourth row blank.
    Sheet("orders", "concat('orders_', o_orderstatus)", "o_orderkey", (
        Column("id", "case when o_orderkey % 4 = 0 then null else o_orderkey end", "i"),
        Column("order date", "case when o_orderkey % 4 = 0 then null else o_orderdate end", "us"),
        Column("order date", "case when o_orderkey % 4 = 0 then null else o_orderdate end", "long"),
        Column("Value", "case when o_orderkey % 4 = 0 then null else o_totalprice end", "d"),
        Column("order date_1", "case when o_orderkey % 4 = 0 then null else ' ' || o_orderpriority || ' ' end"),
    )),
    # Two unnamed empty columns of seven.
    Sheet("events", "concat('events_', event_type)", "event_id", (
        Column("event_id", "event_id", "i"),
        Column("", _NOTHING),
        Column("timestamp", "ts", "t"),
        Column("user", "user_id", "i"),
        Column("", _NOTHING),
        Column("value", "value", "d"),
        Column("props", "case when event_id % 7 = 0 then 'N/A' else props end"),
    )),
    # Mostly blank, no header.
    Sheet("part", "concat('part_', p_brand)", "p_partkey", (
        Column("", "case when p_partkey % 3 = 0 then p_name else null end"),
        Column("", "case when p_partkey % 5 = 0 then p_retailprice else null end", "d"),
        Column("", "case when p_partkey % 2 = 0 then 'null' else p_type end"),
        Column("", "case when p_partkey % 11 = 0 then p_size else null end", "i"),
    ), header=False),
    # Numbers and dates spoiled to several degrees; signs, zeros and exponents.
    Sheet("supplier", "'supplier_mixed'", "s_suppkey", (
        Column("key", "concat('00', cast(s_suppkey as string))"),
        Column("price", "case when s_suppkey % 4 = 0 then 'n.a.' else cast(cast(s_acctbal as decimal(18,2)) as string) end"),
        Column("cost", "case when s_suppkey % 7 = 0 then '$5' else concat('+', cast(s_nationkey as string), '.50') end"),
        Column("count", "case when s_suppkey % 3 = 0 then concat(cast(s_nationkey as string), 'e2') else ' 7 ' end"),
        Column("when", "case when s_suppkey % 6 = 0 then 'soon' when s_suppkey % 6 = 1 then '2024-02-30' "
                       "when s_suppkey % 6 = 2 then '20240229' else '2024-02-28T10:30' end"),
        Column("label", "case when s_suppkey % 2 = 0 then '  ' else ' nan' end"),
    )),
    # One long run of numbered lines without text.
    Sheet("lineitem", "concat('lines_', l_returnflag)", "l_orderkey * 8 + l_linenumber", (
        Column("", "l_linenumber", "i"),
        Column("", "l_quantity", "d"),
        Column("", "l_tax", "d"),
    ), header=False),
)


def _typed(column: Column) -> str:
    if column.kind == "us":
        return f"date_format({column.expr}, 'MM/dd/yyyy')"
    if column.kind == "long":
        return f"date_format({column.expr}, 'MMM d, yyyy')"
    return column.expr


def sources_of(spark: SparkSession, sf_dir: str, sheets: tuple[Sheet, ...]) -> list[GridSource]:
    """The corpus as sources, which can be read column by column."""
    sources = []
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in dict.fromkeys(s.table for s in sheets)}
    for sheet in sheets:
        frame = tables[sheet.table].selectExpr(
            f"{sheet.table_id} AS _table",
            f"CAST({sheet.position} AS BIGINT) AS _position",
            *[f"{_typed(c)} AS c{i}" for i, c in enumerate(sheet.columns)],
        )
        name = sheet.table_id.strip("'") if sheet.table_id.startswith("'") else F.col("_table")
        sources.append(GridSource(
            frame, name, F.col("_position"),
            columns=tuple(f"c{i}" for i in range(len(sheet.columns))),
            names=tuple(c.header for c in sheet.columns),
            header=sheet.header, double_scale=2,
        ))
    return sources


def grid_of(spark: SparkSession, sf_dir: str, sheets: tuple[Sheet, ...]) -> DataFrame:
    """The corpus as one grid."""
    return corpus_grid(sources_of(spark, sf_dir, sheets))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Cell texts that stand for "no value", stated for the SQL forms on their own.
NO_VALUE = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]
TOKENS_SQL = "(" + ", ".join(_quoted(t) for t in NO_VALUE) + ")"


def _cell_sql(column: Column) -> str:
    expr = f"({column.expr})"
    text = {
        "s": f"cast({expr} as varchar)",
        "i": f"cast({expr} as varchar)",
        "d": f"cast(cast({expr} as decimal(18,2)) as varchar)",
        "t": f"strftime({expr}, '%Y-%m-%d %H:%M:%S')",
        "us": f"strftime({expr}, '%m/%d/%Y')",
        "long": f"strftime({expr}, '%b %-d, %Y')",
    }[column.kind]
    return f"CASE WHEN {text} IN {TOKENS_SQL} THEN NULL ELSE {text} END"


def grid_sql(sheets: tuple[Sheet, ...]) -> str:
    """CTEs ``grid`` (rows, ranked) and ``cells`` (long form) of the corpus."""
    parts = []
    for sheet in sheets:
        cells = ", ".join(_cell_sql(c) for c in sheet.columns)
        shift = 1 if sheet.header else 0
        parts.append(
            f"SELECT {sheet.table_id} AS table_id, CAST({sheet.position} AS BIGINT) + {shift} AS row_idx, "
            f"[{cells}] AS cells FROM {sheet.table}"
        )
        if sheet.header:
            names = ", ".join(
                "CAST(NULL AS VARCHAR)" if c.header in NO_VALUE else _quoted(c.header) for c in sheet.columns
            )
            parts.append(f"SELECT DISTINCT {sheet.table_id}, CAST(0 AS BIGINT), [{names}] FROM {sheet.table}")
    union = "\n  UNION ALL ".join(parts)
    return f"""raw_grid AS MATERIALIZED (
  {union}
),
grid AS (
  SELECT table_id, row_idx, cells, row_number() OVER (
    PARTITION BY table_id
    ORDER BY row_idx, array_to_string(list_transform(cells, lambda c: coalesce(c, '')), chr(31))
  ) - 1 AS rank
  FROM raw_grid
),
cells AS MATERIALIZED (
  SELECT table_id, row_idx, rank, unnest(range(len(cells))) AS col_idx, unnest(cells) AS value FROM grid
)"""
