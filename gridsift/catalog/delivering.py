"""Queries on cleaning, naming and writing."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridsift.catalog import query
from gridsift.catalog import sql as Q
from gridsift.catalog.books import write_books
from gridsift.catalog.corpora import DIRTY, SHEETS, sources_of
from gridsift.catalog.scalars import format_number_sql
from gridsift.catalog.scoring import TWO
from gridsift.functions import sanitize_name
from gridsift.operators import clean as N
from gridsift.operators import confidence as C
from gridsift.operators import delivery as V
from gridsift.operators import ledger as L
from gridsift.plans import number_within
from gridsift.session import checkpoint_dir, materialize
from gridsift.settings import OutputSettings, WatchSettings
from gridsift.sources import workbook as B
from gridsift.sources import writers as W

# Worksheets delivered cell by cell: all of them, long and multi-line texts too.
CLEANED = SHEETS + DIRTY


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder next to the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/gridsift-{label}-{uuid.uuid4().hex}"


NAMES = f"""promo AS (SELECT table_id, text_ratio > 6e-1 OR change_ratio > 3e-1 AS promoted FROM rule),
plain_names AS (
  SELECT table_id, col_idx, promoted, CASE WHEN promoted THEN coalesce({Q.strip('v0')}, 'Column_' || (col_idx + 1))
    ELSE 'Column_' || (col_idx + 1) END AS name
  FROM two JOIN promo USING (table_id)
),
taken AS (
  SELECT table_id, regexp_extract(name, '^(.*)_([1-9][0-9]{{0,8}})\\z', 1) AS name,
    list_sort(list(DISTINCT CAST(regexp_extract(name, '^(.*)_([1-9][0-9]{{0,8}})\\z', 2) AS BIGINT))) AS used
  FROM plain_names WHERE regexp_matches(name, '^(.*)_([1-9][0-9]{{0,8}})\\z') GROUP BY 1, 2
),
again AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.table_id, p.name ORDER BY col_idx) - 1 AS nth, coalesce(used, []) AS used
  FROM plain_names p LEFT JOIN taken t ON t.table_id = p.table_id AND t.name = p.name
),
unique_cols AS (
  SELECT table_id, col_idx, name, promoted, CASE WHEN nth = 0 THEN name ELSE name || '_' ||
    (SELECT min(k) FROM range(1, 1000) r(k)
     WHERE NOT list_contains(used, k) AND k - len(list_filter(used, lambda u: u <= k)) = nth) END AS unique_name
  FROM again
)"""


@query(Q.with_corpus(SHEETS + DIRTY, TWO, NAMES, query="""
SELECT table_id, col_idx, name, unique_name, promoted FROM unique_cols"""))
def set_headers(spark, sf_dir):
    """Column names of every worksheet, made unique."""
    names = N.set_headers(C.profile(sources_of(spark, sf_dir, SHEETS + DIRTY)))
    return names.select("table_id", "col_idx", "name", "unique_name", "promoted")


@query("""
WITH names AS (
  SELECT c_nationkey AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS col_idx,
    lower(left(c_mktsegment, 1)) || CASE WHEN c_custkey % 4 = 0 THEN '_' || (c_custkey % 3) ELSE '' END AS name
  FROM customer
),
taken AS (
  SELECT t, regexp_extract(name, '^(.*)_([1-9][0-9]*)\\z', 1) AS name,
    list(DISTINCT CAST(regexp_extract(name, '^(.*)_([1-9][0-9]*)\\z', 2) AS BIGINT)) AS used
  FROM names WHERE regexp_matches(name, '^(.*)_([1-9][0-9]*)\\z') GROUP BY 1, 2
),
again AS (
  SELECT n.*, row_number() OVER (PARTITION BY n.t, n.name ORDER BY col_idx) - 1 AS nth, coalesce(used, []) AS used
  FROM names n LEFT JOIN taken k ON k.t = n.t AND k.name = n.name
)
SELECT cast(t as varchar) AS table_id, col_idx, name, CASE WHEN nth = 0 THEN name ELSE name || '_' ||
  (SELECT min(k) FROM range(1, 1000000) r(k)
   WHERE NOT list_contains(used, k) AND k - len(list_filter(used, lambda u: u <= k)) = nth) END AS unique_name
FROM again""")
def unique_names(spark, sf_dir):
    """Wide tables full of repeated names, some of which look like made ones."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    names = number_within(customer.select("c_nationkey", "c_custkey", "c_mktsegment"), ["c_nationkey"], ["c_custkey"], "place").select(
        F.col("c_nationkey").cast("string").alias("table_id"),
        (F.col("place") - 1).cast("int").alias("col_idx"),
        F.expr("lower(left(c_mktsegment, 1)) || CASE WHEN c_custkey % 4 = 0 THEN '_' || (c_custkey % 3) ELSE '' END").alias("name"),
    )
    return N.unique_names(names)


KINDS = f"""data_cells AS (
  SELECT c.*, promoted, rank >= CAST(promoted AS INT) AS is_data,
    rank >= CAST(promoted AS INT) AND rank < CAST(promoted AS INT) + 10 AS sampled
  FROM cells c JOIN promo USING (table_id)
),
kinds AS (
  SELECT table_id, col_idx, CASE
    WHEN count(*) FILTER (WHERE is_data AND {Q.is_number('value')}) > count(*) FILTER (WHERE is_data) * 7e-1 THEN 'number'
    WHEN count(*) FILTER (WHERE sampled) > 0
      AND count(*) FILTER (WHERE sampled AND {Q.is_date('value')}) > count(*) FILTER (WHERE sampled) * 8e-1 THEN 'date'
    ELSE 'text' END AS kind
  FROM data_cells GROUP BY table_id, col_idx
)"""

_CLEAN = """cleaned AS (
  SELECT table_id, row_idx, rank, col_idx, CASE kind WHEN 'number' THEN {number}
    WHEN 'date' THEN coalesce(strftime({date}, '%Y-%m-%d %H:%M:%S'), '')
    ELSE CASE WHEN coalesce({text}, '') = 'nan' THEN '' ELSE coalesce({text}, '') END END AS value
  FROM data_cells JOIN kinds USING (table_id, col_idx) WHERE is_data
)"""

CLEAN = _CLEAN.format(
    number=f"coalesce({format_number_sql('value')}, '')", date=Q.timestamp("value"), text=Q.strip("value")
)
CLEAN_G6 = _CLEAN.format(
    number=f"coalesce(printf('%g', {Q.number('value')}), '')", date=Q.timestamp("value"), text=Q.strip("value")
)


@query(Q.with_corpus(CLEANED, TWO, NAMES, KINDS, query="SELECT * FROM kinds"))
def column_kinds(spark, sf_dir):
    """How each column is written."""
    known = C.profile(sources_of(spark, sf_dir, CLEANED))
    return N.column_kinds(known, N.set_headers(known))


# Positions repeat in some tables, ranks do not.
_ROWS = "SELECT table_id, row_idx, md5(string_agg(value, '|' ORDER BY col_idx)) AS row_md5 FROM cleaned GROUP BY table_id, row_idx, rank"


def _row_digests(rows):
    return rows.select("table_id", "row_idx", F.md5(F.array_join("cells", "|").cast("binary")).alias("row_md5"))


@query(Q.with_corpus(CLEANED, TWO, NAMES, KINDS, CLEAN, query=_ROWS))
def clean_cells(spark, sf_dir):
    """Cleaned rows of every worksheet, numbers lossless."""
    rows, _ = N.clean_tables(sources_of(spark, sf_dir, CLEANED))
    return _row_digests(rows)


@query(Q.with_corpus(CLEANED, TWO, NAMES, KINDS, CLEAN_G6, query=_ROWS))
def clean_cells_g6(spark, sf_dir):
    """Cleaned rows with six-digit numbers."""
    rows, _ = N.clean_tables(sources_of(spark, sf_dir, CLEANED), compat="g6")
    return _row_digests(rows)


_QUOTE = "'\"' || replace({v}, '\"', '\"\"') || '\"'"
_ACCEPTED = "accepted AS (SELECT table_id FROM judged WHERE round(overall, 12) >= 7e-1)"
_LINES = f"""
SELECT table_id || '.csv' AS output_name, row_idx, string_agg({_QUOTE.format(v='value')}, ',' ORDER BY col_idx) AS line
FROM cleaned JOIN accepted USING (table_id) GROUP BY table_id, row_idx, rank
UNION ALL
SELECT table_id || '.csv', -1, string_agg({_QUOTE.format(v='unique_name')}, ',' ORDER BY col_idx)
FROM unique_cols JOIN accepted USING (table_id) GROUP BY table_id"""

_LINE_PARTS = (*Q.ALL_PARTS, _ACCEPTED, TWO, NAMES, KINDS, CLEAN)


def _accepted(spark, sf_dir):
    known = C.profile(sources_of(spark, sf_dir, CLEANED))
    passed = C.accepted(C.confidence(known))
    return known, passed.select("table_id", sanitize_name(F.col("table_id")).alias("output_name"))


@query(Q.with_corpus(CLEANED, *_LINE_PARTS, query=_LINES))
def delivery_lines(spark, sf_dir):
    """Judge, clean and render: the delivered lines of all accepted worksheets."""
    return W.delivery_lines(*_accepted(spark, sf_dir))


# The lines of the files: a text with line feeds in it takes several.
_FILE_LINES = f"SELECT output_name, unnest(string_split(line, chr(10))) AS line FROM ({_LINES})"


def _file_lines(spark, path):
    lines = spark.read.option("basePath", path).option("lineSep", "\n").schema("value string, output_name string").text(path)
    return lines.select("output_name", F.col("value").alias("line"))


@query(Q.with_corpus(CLEANED, *_LINE_PARTS, query=_FILE_LINES))
def write_tables(spark, sf_dir):
    """The delivered files, written and read back."""
    path = scratch(spark, "tables")
    W.write_tables(*_accepted(spark, sf_dir), path)
    return _file_lines(spark, path)


@query("""
SELECT event_id, coalesce(props, '') AS props, coalesce(note, '') AS note FROM (
  SELECT cast(event_id as varchar) AS event_id, props,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'a "quoted", part \\ ' || event_type END AS note FROM events)""")
def delimited_round_trip(spark, sf_dir):
    """Delimited text, all fields quoted, written and read back; null comes back empty."""
    path = scratch(spark, "delimited")
    note = F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('a \"quoted\", part ', char(92), ' ', event_type) END")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("event_id"), "props", note.alias("note")
    )
    W.write_delimited(events, path, OutputSettings(delimiter=";"))
    back = spark.read.option("header", True).option("sep", ";").option("escape", '"').schema(events.schema).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query("""
SELECT event_id, event_type, CAST(ts AS DATE)::VARCHAR AS log_day FROM events
WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 3""")
def event_log_round_trip(spark, sf_dir):
    """Structured log, a compressed folder per day; old days are pruned when read."""
    path = scratch(spark, "log")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    W.write_event_log(events.select("event_id", "event_type", "ts"), path)
    log = W.read_event_log(spark, path, "event_id bigint, event_type string")
    newest = events.agg(F.max(F.to_date("ts")).alias("day")).first()["day"]
    kept = L.retention(log, 3, F.lit(newest))
    return kept.select("event_id", "event_type", F.col("log_date").cast("string").alias("log_day"))


_TARGETS = """targets AS (
  SELECT p_partkey, replace(p_name, ' ', '_') || '.csv' AS target FROM part
), existing AS (
  SELECT DISTINCT replace(p_name, ' ', '_') || '.csv' AS name FROM part WHERE p_size > 30 AND p_type = 'ECONOMY'
  UNION
  SELECT DISTINCT replace(p_name, ' ', '_') || '_20240131' || CASE WHEN p_size > 40 THEN '_002' ELSE '' END || '.csv'
  FROM part WHERE p_type = 'PROMO'
)"""


def _targets(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    stem = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    targets = part.select("p_partkey", F.concat(stem, F.lit(".csv")).alias("target"))
    plain = part.where("p_size > 30 AND p_type = 'ECONOMY'").select(F.concat(stem, F.lit(".csv")).alias("name"))
    extra = F.when(F.col("p_size") > 40, "_002").otherwise("")
    stamped = part.where("p_type = 'PROMO'").select(
        F.concat(stem, F.lit("_20240131"), extra, F.lit(".csv")).alias("name")
    )
    return targets, plain.unionByName(stamped).distinct()


@query("WITH " + _TARGETS + """
SELECT p_partkey, target FROM targets WHERE target IN (SELECT name FROM existing)""")
def name_conflicts(spark, sf_dir):
    return V.name_conflicts(*_targets(spark, sf_dir))


@query("WITH " + _TARGETS + """
SELECT p_partkey, target FROM targets WHERE target NOT IN (SELECT name FROM existing)""")
def free_names(spark, sf_dir):
    return V.free_names(*_targets(spark, sf_dir))


@query("WITH " + _TARGETS + """,
asked AS (
  SELECT p_partkey, target, regexp_replace(target, '\\.csv$', '') AS stem,
    row_number() OVER (PARTITION BY target ORDER BY p_partkey) AS request FROM targets
),
made AS (
  SELECT target, step, CASE WHEN step = 0 THEN target WHEN step = 1 THEN stem || '_20240131.csv'
    ELSE stem || '_20240131_' || printf('%03d', step - 1) || '.csv' END AS name
  FROM (SELECT target, stem, unnest(range(0, most + 10)) AS step
    FROM (SELECT target, stem, max(request) AS most FROM asked GROUP BY target, stem))
),
free AS (
  SELECT target, name, row_number() OVER (PARTITION BY target ORDER BY step) AS request
  FROM made WHERE name NOT IN (SELECT name FROM existing)
)
SELECT p_partkey, a.target, f.name AS output_name,
  CASE WHEN f.name IS NULL THEN 'Too many naming conflicts for file: ' || a.target END AS conflict_error
FROM asked a LEFT JOIN free f ON f.target = a.target AND f.request = a.request""")
def output_names(spark, sf_dir):
    """A name of its own for every target, next to what exists."""
    targets, existing = _targets(spark, sf_dir)
    named = V.resolve_output_names(targets, existing, "20240131", ["p_partkey"])
    return named.select("p_partkey", "target", "output_name", "conflict_error")


@query("""
SELECT o_orderkey, target, CASE request WHEN 1 THEN target WHEN 2 THEN o_orderstatus || '_20240131.csv'
  ELSE o_orderstatus || '_20240131_' || printf('%03d', request - 2) || '.csv' END AS output_name
FROM (SELECT o_orderkey, o_orderstatus, o_orderstatus || '.csv' AS target,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS request FROM orders)""")
def output_names_crowded(spark, sf_dir):
    """Three names that a third of all rows want each: every one gets a name of its own."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    targets = orders.select("o_orderkey", F.concat("o_orderstatus", F.lit(".csv")).alias("target"))
    named = V.resolve_output_names(targets, spark.createDataFrame([], "name string"), "20240131", ["o_orderkey"])
    return named.select("o_orderkey", "target", "output_name")


@query(Q.with_corpus(DIRTY, Q.TABLES, query="""
SELECT table_id, 'book_' || regexp_replace(table_id, '[^\\p{L}\\p{N}._\\- ]', '', 'g') || '.csv' AS target FROM tabs"""))
def target_names(spark, sf_dir):
    """The naming pattern applied to every worksheet."""
    tables = C.profile(sources_of(spark, sf_dir, DIRTY)).tables
    return V.target_names(tables.select("table_id"), F.lit("book"), F.col("table_id"))


@query("""
WITH outcomes AS (
  SELECT DISTINCT '/in/' || (o_custkey % 7) || '/' || o_orderpriority || '.xlsx' AS source,
    '/in/' || (o_custkey % 7) || '/archive/' || o_orderpriority AS stem FROM orders WHERE o_orderstatus <> 'P'
), existing AS (
  SELECT DISTINCT '/in/' || (o_custkey % 7) || '/archive/' || o_orderpriority || '.xlsx' AS name
  FROM orders WHERE o_totalprice > 400000
)
SELECT source, CASE WHEN name IS NULL THEN stem || '.xlsx' ELSE stem || '_20240131.xlsx' END AS archive_path
FROM outcomes LEFT JOIN existing ON name = stem || '.xlsx'""")
def archive_plan(spark, sf_dir):
    """Archive places of consumed inputs; names taken there get a time stamp."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    folder = F.concat(F.lit("/in/"), (F.col("o_custkey") % 7).cast("string"), F.lit("/"))
    outcomes = orders.select(
        F.concat(folder, F.col("o_orderpriority"), F.lit(".xlsx")).alias("source"),
        (F.col("o_orderstatus") != "P").alias("success"),
    ).groupBy("source").agg(F.bool_or("success").alias("success"))
    existing = orders.where("o_totalprice > 400000").select(
        F.concat(folder, F.lit("archive/"), F.col("o_orderpriority"), F.lit(".xlsx")).alias("name")
    ).distinct()
    return V.archive_plan(outcomes, existing, "20240131").select("source", "archive_path")


@query(Q.with_corpus(CLEANED, *_LINE_PARTS, query=f"""
{_FILE_LINES} UNION ALL
SELECT replace(output_name, '.csv', '_20240131.csv'), line FROM ({_FILE_LINES})""").replace(
    "table_id || '.csv'", "'book_' || regexp_replace(table_id, '[^\\p{L}\\p{N}._\\- ]', '', 'g') || '.csv'"))
def deliver(spark, sf_dir):
    """Two delivery runs into one folder: the second keeps the files of the first."""
    known = C.profile(sources_of(spark, sf_dir, CLEANED))
    scores, path = materialize(C.confidence(known)), scratch(spark, "deliver")
    for _ in range(2):
        W.deliver(known, scores, path, "20240131", F.lit("book"), F.col("table_id"))
    return _file_lines(spark, path)


_SHEETS = """WITH placed AS (
  SELECT *, 'book_' || (p_partkey // 5000) || '.xlsx' AS book, 'parts ' || (p_partkey // 500) AS sheet,
    row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) AS row_idx
  FROM part
)"""


def _part_books(spark, sf_dir) -> str:
    """Workbooks of 5,000 part keys each, 500 to a sheet, under a name row; returns their folder."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    number = lambda n: F.floor(F.col("p_partkey") / n).cast("string")
    rows = part.select(
        F.concat(F.lit("book_"), number(5000), F.lit(".xlsx")).alias("book"), F.concat(F.lit("parts "), number(500)).alias("sheet"),
        F.col("p_partkey").alias("row"), F.array(F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string")).alias("cells"),
    )
    path = scratch(spark, "books")
    write_books(rows, path, ["key", "name", "size"])
    return path


@query(_SHEETS + """
SELECT book, sheet, CAST(row_idx AS BIGINT) AS row_idx, CAST(p_partkey AS VARCHAR) AS c0, p_name AS c1, CAST(p_size AS VARCHAR) AS c2 FROM placed
UNION ALL SELECT DISTINCT book, sheet, 0, 'key', 'name', 'size' FROM placed""")
def workbook_cells(spark, sf_dir):
    """The rows of workbooks written from ``part``, read sheet by sheet."""
    grid = B.workbook_grid(B.read_workbooks(spark, WatchSettings(folders=(_part_books(spark, sf_dir),))))
    return grid.select(
        F.regexp_extract("table_id", r"([^/]+)#", 1).alias("book"), F.substring_index("table_id", "#", -1).alias("sheet"),
        "row_idx", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(3)],
    )


@query(_SHEETS + """
SELECT book, sheet, count(*) + 1 AS max_row, CAST(3 AS INTEGER) AS max_column, 'visible' AS sheet_state FROM placed
WHERE sheet LIKE '%0' GROUP BY book, sheet""")
def workbook_facts(spark, sf_dir):
    """Sizes of the sheets whose names end with 0; the others are not read."""
    records = B.read_workbooks(spark, WatchSettings(folders=(_part_books(spark, sf_dir),)), names=["parts *0"])
    return B.workbook_sheets(records).select(
        F.substring_index("source_path", "/", -1).alias("book"), F.col("sheet_name").alias("sheet"), "max_row", "max_column", "sheet_state"
    )


_BOOK_LINES = Q.with_corpus(CLEANED, *_LINE_PARTS, query=_FILE_LINES).replace(
    "table_id || '.csv'", "'book_' || regexp_replace(table_id, '[^\\p{L}\\p{N}._\\- ]', '', 'g') || '.csv'")


@query(_BOOK_LINES)
def deliver_overwrite(spark, sf_dir):
    """Two delivery runs into one folder without time stamps: the second replaces the files of the first."""
    known = C.profile(sources_of(spark, sf_dir, CLEANED))
    scores, path = materialize(C.confidence(known)), scratch(spark, "deliver")
    for headers in (False, True):
        output = OutputSettings(include_timestamp=False, include_headers=headers)
        W.deliver(known, scores, path, "20240131", F.lit("book"), F.col("table_id"), output)
    return _file_lines(spark, path)


@query(_BOOK_LINES.replace("SELECT output_name, unnest", "SELECT output_name, 'in' || (length(output_name) % 2) AS folder, unnest"))
def deliver_by_source(spark, sf_dir):
    """Tables of files in two folders, each delivered next to its file."""
    known = C.profile(sources_of(spark, sf_dir, CLEANED))
    path = scratch(spark, "beside")
    name = F.length(sanitize_name(F.concat(F.lit("book_"), F.col("table_id"), F.lit(".csv")))) % 2
    place = F.concat(F.lit(f"{path}/in"), name.cast("string"), F.lit("/book.xlsx"))
    W.deliver_by_source(known, C.confidence(known), None, place, F.col("table_id"))
    both = [f"{path}/in0", f"{path}/in1"]
    frames = [_file_lines(spark, p).withColumn("folder", F.lit(p[-3:])) for p in both]
    return frames[0].unionByName(frames[1]).select("output_name", "folder", "line")
