"""Queries on single-value functions, over all cells of a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift import functions as X
from gridsift.catalog import query
from gridsift.catalog import sql as Q
from gridsift.catalog.corpora import DIRTY, SHEETS, grid_of
from gridsift.operators.grid import to_cells

# Whole texts next to number and date cells of every spelling.
VALUES = tuple(s for s in DIRTY if s.table in ("supplier", "orders")) + tuple(
    s for s in SHEETS if s.table in ("documents", "supplier")
)


def _cells(spark, sf_dir, sheets=VALUES):
    return to_cells(grid_of(spark, sf_dir, sheets), keep_empty=False)


@query(Q.with_corpus(VALUES, query=f"""
SELECT table_id, row_idx, col_idx, {Q.number('value')} AS num FROM cells WHERE value IS NOT NULL"""))
def parse_numbers(spark, sf_dir):
    return _cells(spark, sf_dir).select("table_id", "row_idx", "col_idx", X.number_of(F.col("value")).alias("num"))


@query(Q.with_corpus(VALUES, query=f"""
SELECT table_id, row_idx, col_idx, epoch_us({Q.timestamp('value')}) AS at_us FROM cells WHERE value IS NOT NULL"""))
def parse_dates(spark, sf_dir):
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), X.timestamp_of(F.col("value")))
    return _cells(spark, sf_dir).select("table_id", "row_idx", "col_idx", at.alias("at_us"))


def _plain(v: str) -> str:
    out = f"regexp_replace({v}, '^\\+', '')"
    out = f"regexp_replace({out}, '^(-?)0+([0-9])', '\\1\\2')"
    out = f"regexp_replace({out}, '^(-?)\\.', '\\10.')"
    return f"CASE WHEN contains({out}, '.') THEN regexp_replace({out}, '\\.?0*$', '') ELSE {out} END"


def format_number_sql(v: str) -> str:
    text = Q.strip(v)
    spelled = f"CAST(TRY_CAST({text} AS DECIMAL(38,18)) AS VARCHAR)"
    return (
        f"CASE WHEN {Q.is_number(v)} THEN CASE WHEN contains(lower({v}), 'e') THEN "
        f"CASE WHEN CAST(TRY_CAST({text} AS DECIMAL(38,18)) AS DOUBLE) = {Q.number(v)} THEN {_plain(spelled)} ELSE {text} END "
        f"ELSE {_plain(text)} END ELSE '' END"
    )


@query(Q.with_corpus(VALUES, query=f"""
SELECT table_id, row_idx, col_idx, {format_number_sql('value')} AS written FROM cells WHERE value IS NOT NULL"""))
def format_numbers(spark, sf_dir):
    """Lossless plain form of every number."""
    written = X.format_number(F.col("value")).alias("written")
    return _cells(spark, sf_dir).select("table_id", "row_idx", "col_idx", written)


@query(Q.with_corpus(VALUES, query=f"""
SELECT table_id, row_idx, col_idx, coalesce(printf('%g', {Q.number('value')}), '') AS written
FROM cells WHERE value IS NOT NULL"""))
def format_numbers_g6(spark, sf_dir):
    """Six significant digits."""
    written = X.format_g6(F.col("value")).alias("written")
    return _cells(spark, sf_dir).select("table_id", "row_idx", "col_idx", written)


@query(Q.with_corpus(VALUES, query=f"""
SELECT table_id, row_idx, col_idx, coalesce(strftime({Q.timestamp('value')}, '%Y-%m-%d %H:%M:%S'), '') AS written
FROM cells WHERE value IS NOT NULL"""))
def format_dates(spark, sf_dir):
    written = X.format_date(F.col("value")).alias("written")
    return _cells(spark, sf_dir).select("table_id", "row_idx", "col_idx", written)


@query(Q.with_corpus(VALUES, query=f"""
SELECT table_id, row_idx, col_idx, CASE WHEN {Q.strip('value')} = 'nan' THEN '' ELSE {Q.strip('value')} END AS cleaned
FROM cells WHERE value IS NOT NULL"""))
def clean_text(spark, sf_dir):
    cleaned = X.clean_text(F.col("value")).alias("cleaned")
    return _cells(spark, sf_dir).select("table_id", "row_idx", "col_idx", cleaned)


@query(Q.with_corpus(SHEETS + DIRTY, query=f"""
SELECT table_id, row_idx, col_idx, {Q.alpha('value')} AS alpha, {Q.digits('value')} AS digits,
  {Q.header_word('value')} AS header_word FROM cells WHERE value IS NOT NULL"""))
def label_tests(spark, sf_dir):
    """Label tests on every cell of every worksheet."""
    value = F.col("value")
    return _cells(spark, sf_dir, SHEETS + DIRTY).select(
        "table_id", "row_idx", "col_idx",
        X.is_alpha_label(value).alias("alpha"), X.is_digit_label(value).alias("digits"),
        X.is_header_word(value).alias("header_word"),
    )


@query("""
SELECT p_partkey, p_name FROM part
WHERE regexp_matches(lower(p_name), '^.*ring\\z') OR regexp_matches(lower(p_name), '^[^a-q].d .*\\z')""")
def glob_match(spark, sf_dir):
    """Names that match any of some globs, letter case aside."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.where(X.match_glob(F.col("p_name"), ["*RING", "[!a-q]?d *"])).select("p_partkey", "p_name")


def sanitize_sql(v: str) -> str:
    safe = f"trim(regexp_replace(regexp_replace({v}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '_+', '_', 'g'), '_.')"
    return f"""(WITH a AS (SELECT CASE WHEN {safe} = '' THEN 'worksheet' ELSE {safe} END AS s),
    b AS (SELECT s, regexp_extract(s, '(?s)^.*[^.].*(\\.[^.]*)\\z', 1) AS ext FROM a),
    c AS (SELECT substr(substr(s, 1, length(s) - length(ext)), 1, 200) || ext AS s FROM b)
    SELECT CASE WHEN lower(s) LIKE '%.csv' THEN s ELSE s || '.csv' END FROM c)"""


@query(f"""WITH names AS (
  SELECT doc_id, '_' || source || ': ' || lang || '/' || text || '.' AS raw FROM documents
)
SELECT doc_id, {sanitize_sql('raw')} AS safe FROM names""")
def sanitize_names(spark, sf_dir):
    """Safe file names out of whole texts."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.concat(F.lit("_"), "source", F.lit(": "), "lang", F.lit("/"), "text", F.lit("."))
    return documents.select("doc_id", X.sanitize_name(raw).alias("safe"))


@query("""
SELECT page_id, 'book_' || trim(regexp_replace(url, '[^\\p{L}\\p{N}._\\- ]', '', 'g')) || '_20240131.csv' AS name FROM pages""")
def make_names(spark, sf_dir):
    """Naming pattern with a sheet name and a time stamp."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    name = X.make_name("{filename}_{worksheet}.csv", F.lit("book"), F.col("url"), F.lit("20240131"))
    return pages.select("page_id", name.alias("name"))


@query("""
SELECT doc_id, CASE WHEN contains(lower(text), 'password') OR contains(lower(text), 'token') OR contains(lower(text), 'secret')
    OR lower(text) = 'key' THEN '[REDACTED]'
  WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS logged
FROM documents""")
def redact_texts(spark, sf_dir):
    """Log form of values: secrets hidden, long ones cut."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select("doc_id", X.redact(F.col("text")).alias("logged"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS logged FROM documents""")
def brief_results(spark, sf_dir):
    """Log form of results: long ones cut."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select("doc_id", X.brief_result(F.col("text")).alias("logged"))


@query("""
SELECT event_id, CASE WHEN regexp_matches(lower(k), 'password|token|secret') OR suffix(lower(k), 'key') THEN '[REDACTED]'
  ELSE props END AS logged
FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'api_KEY' WHEN 1 THEN 'userToken' WHEN 2 THEN 'keyboard' ELSE 'props' END AS k FROM events)""")
def redact_props(spark, sf_dir):
    """Log form of named values."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.expr("CASE event_id % 4 WHEN 0 THEN 'api_KEY' WHEN 1 THEN 'userToken' WHEN 2 THEN 'keyboard' ELSE 'props' END")
    return events.select("event_id", X.redact_entry(key, F.col("props")).alias("logged"))


@query("""
SELECT event_id, CASE WHEN event_id % 9 <= 0 THEN 5e0 ELSE least(5e0 * power(2, event_id % 9), 60e0) END AS seconds FROM events""")
def backoff_delays(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", X.backoff(F.col("event_id") % 9).alias("seconds"))
