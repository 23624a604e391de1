"""SQL texts of the same formulas, written for a second engine.

Number literals use exponents (``3e-1``) so they are doubles, not decimals.
"""

from __future__ import annotations

from gridsift.catalog.corpora import Sheet, grid_sql

# Fixed values, stated here on their own so that the SQL forms check the engine's:
# code points that are trimmed, spellings of numbers and dates, header words.
SPACE = " || ".join(
    f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
)
NUMBER_RE = r"^[ \t\n\x0B\f\r]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\x0B\f\r]*\z"
_YEAR = "(167[89]|16[89][0-9]|1[789][0-9][0-9]|2[01][0-9][0-9]|22[0-5][0-9]|226[01])"
DATE_RE = (
    r"^[ \t\n\x0B\f\r]*("
    + _YEAR + r"-[0-9][0-9]-[0-9][0-9]([ T][0-9][0-9]:[0-9][0-9](:[0-9][0-9](\.[0-9]{1,6})?)?)?"
    "|" + _YEAR + "([0-9][0-9][0-9][0-9])?"
    "|" + _YEAR + "/[0-9][0-9]?/[0-9][0-9]?"
    "|[0-9][0-9]?/[0-9][0-9]?/" + _YEAR
    + "|[A-Za-z][A-Za-z][A-Za-z] [0-9][0-9]?, " + _YEAR
    + r")[ \t\n\x0B\f\r]*\z"
)
HEADER_WORDS = (
    "amount category code comments count date description id identifier key label name notes number quantity ref "
    "reference state status time timestamp title type value"
).split()


def strip(v: str) -> str:
    return f"trim({v}, {SPACE})"


def number(v: str) -> str:
    text = f"TRY_CAST({strip(v)} AS DOUBLE)"
    return f"CASE WHEN regexp_matches({v}, '{NUMBER_RE}') AND isfinite({text}) THEN {text} END"


def is_number(v: str) -> str:
    return f"(({number(v)}) IS NOT NULL)"


def timestamp(v: str) -> str:
    plain = f"translate({strip(v)}, 'T', ' ')"
    parsed = (
        f"try_strptime({plain}, ['%Y-%m-%d', '%Y-%m-%d %H:%M', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M:%S.%f', "
        f"'%Y%m%d', '%Y', '%Y/%m/%d', '%m/%d/%Y', '%d/%m/%Y', '%b %d, %Y'])"
    )
    return (
        f"CASE WHEN regexp_matches({v}, '{DATE_RE}') AND year({parsed}) BETWEEN 1678 AND 2261 THEN {parsed} END"
    )


def is_date(v: str) -> str:
    return f"(({timestamp(v)}) IS NOT NULL)"


def alpha(v: str) -> str:
    return f"regexp_matches(translate({v}, ' _-', ''), '^\\p{{L}}+\\z')"


def digits(v: str) -> str:
    return f"regexp_matches(translate({v}, '.-', ''), '^\\p{{Nd}}+\\z')"


def header_word(v: str) -> str:
    return f"regexp_matches(lower({v}), '^({'|'.join(HEADER_WORDS)})\\z')"


def has(v: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains(lower({v}), '{w}')" for w in words) + ")"


def deviation(total: str, squares: str, count: str) -> str:
    return (
        f"sqrt(greatest(({squares} - CAST({total} AS DOUBLE) * {total} / {count}) / "
        f"nullif(CAST({count} AS DOUBLE) - 1, 0), 0e0))"
    )


COLUMNS = f"""cols AS (
  SELECT table_id, col_idx, count(*) AS nrows, count(value) AS n,
    count(*) FILTER (WHERE {is_number('value')}) AS numbers,
    count(*) FILTER (WHERE {is_date('value')}) AS dates,
    coalesce(sum(length(value)), 0) AS len,
    coalesce(sum(CAST(length(value) AS DOUBLE) * length(value)), 0e0) AS len2,
    count(DISTINCT value) AS distinct_values
  FROM cells GROUP BY table_id, col_idx
)"""

TABLES = """row_counts AS (
  SELECT table_id, rank, count(value) AS filled, count(*) AS width FROM cells GROUP BY table_id, rank
),
by_row AS (
  SELECT table_id, count(*) AS nrows, max(width) AS ncols, sum(filled) AS filled,
    count(*) FILTER (WHERE filled > 0) AS rows_any,
    count(*) FILTER (WHERE filled = width) AS rows_full,
    sum(CAST(filled AS DOUBLE) * filled) AS filled2
  FROM row_counts GROUP BY table_id
),
by_col AS (
  SELECT table_id, count(*) FILTER (WHERE n > 0) AS cols_any, count(*) FILTER (WHERE n = nrows) AS cols_full
  FROM (SELECT table_id, col_idx, count(value) AS n, count(*) AS nrows FROM cells GROUP BY ALL)
  GROUP BY table_id
),
tabs AS (SELECT * FROM by_row JOIN by_col USING (table_id))"""

DENSITY = f"""clustered AS (
  SELECT *, CAST(filled AS DOUBLE) / (nrows * ncols) AS density,
    CAST(nrows - rows_any AS DOUBLE) / nrows AS empty_rows,
    CAST(ncols - cols_any AS DOUBLE) / ncols AS empty_cols,
    ((CAST(rows_any AS DOUBLE) / nrows + CAST(cols_any AS DOUBLE) / ncols) / 2) * 6e-1
      + greatest(0e0, 1 - coalesce({deviation('filled', 'filled2', 'nrows')} / ncols, 0e0)) * 4e-1 AS clustering_score
  FROM tabs
),
bonused AS (
  SELECT *, CASE WHEN clustering_score > 7e-1 THEN least(2e-1, clustering_score * 25e-2)
    WHEN clustering_score > 5e-1 THEN least(1e-1, clustering_score * 15e-2) ELSE 0e0 END AS bonus
  FROM clustered
),
dense AS (
  SELECT table_id, density, CASE
    WHEN density < 1e0 - 3e-1 THEN density * 5e-1
    WHEN density > 8e-1 THEN least(1e0, density * 12e-1)
    ELSE greatest(0e0, least(1e0,
      density * (CASE WHEN empty_rows > 2e-1 THEN 1 - empty_rows * 5e-1 ELSE 1e0 END)
              * (CASE WHEN empty_cols > 2e-1 THEN 1 - empty_cols * 5e-1 ELSE 1e0 END) + bonus)) END AS density_score,
    list_filter([
      CASE WHEN density < 1e0 - 3e-1 THEN printf('Low data density: %.3f', density) END,
      CASE WHEN density >= 1e0 - 3e-1 AND density > 8e-1 THEN printf('Good data density: %.3f', density) END,
      CASE WHEN density BETWEEN 1e0 - 3e-1 AND 8e-1 AND empty_rows > 2e-1 THEN printf('Too many empty rows: %.3f', empty_rows) END,
      CASE WHEN density BETWEEN 1e0 - 3e-1 AND 8e-1 AND empty_cols > 2e-1 THEN printf('Too many empty columns: %.3f', empty_cols) END,
      CASE WHEN density BETWEEN 1e0 - 3e-1 AND 8e-1 AND bonus > 0 THEN 'Data shows good clustering pattern' END
    ], lambda r: r IS NOT NULL) AS density_reasons
  FROM bonused
)"""


def _grade(share: str, high: str, good: str, fair: str, rest: str) -> str:
    return (
        f"CASE WHEN {share} > 9e-1 THEN {high} WHEN {share} > 8e-1 THEN {good} "
        f"WHEN {share} > 6e-1 THEN {fair} ELSE {share} * {rest} END"
    )


CONSISTENCY = f"""graded AS (
  SELECT *,
    {_grade('(CAST(numbers AS DOUBLE) / n)', '95e-2', '8e-1', '6e-1', '5e-1')} AS numeric_score,
    {_grade('(CAST(dates AS DOUBLE) / n)', '9e-1', '75e-2', '6e-1', '4e-1')} AS date_score,
    ((CASE WHEN len > 0 THEN greatest(0e0, 1 - coalesce({deviation('len', 'len2', 'n')}, 0e0) / (CAST(len AS DOUBLE) / n)) ELSE 0e0 END)
      + CASE WHEN CAST(distinct_values AS DOUBLE) / n BETWEEN 1e-1 AND 8e-1 THEN 8e-1
             WHEN CAST(distinct_values AS DOUBLE) / n < 1e-1 THEN 6e-1 ELSE 4e-1 END) / 2 AS categorical_score
  FROM cols WHERE n > 0
),
scored AS (
  SELECT *, CASE WHEN n <= 1 THEN 5e-1 WHEN numeric_score > 8e-1 THEN numeric_score
    WHEN date_score > 8e-1 THEN date_score
    ELSE greatest(numeric_score, date_score, categorical_score) END AS column_score
  FROM graded
),
rated AS (
  SELECT table_id, avg(column_score) AS mean, avg(CASE WHEN column_score > 7e-1 THEN 1e0 ELSE 0e0 END) AS good
  FROM scored GROUP BY table_id
),
consistent AS (
  SELECT table_id, greatest(0e0, least(1e0, CASE WHEN good > 8e-1 THEN least(1e0, mean + 1e-1)
      WHEN good > 6e-1 THEN mean ELSE mean * 8e-1 END)) AS consistency_score,
    (CASE WHEN good > 8e-1 THEN 'High' WHEN good > 6e-1 THEN 'Moderate' ELSE 'Low' END)
      || printf(' consistency across %.1f%% of columns', good * 100) AS consistency_reason
  FROM rated
)"""

HEADERS = f"""candidates AS (
  SELECT table_id, rank, col_idx, coalesce({strip('value')}, '') AS name FROM cells WHERE rank < 5
),
firsts AS MATERIALIZED (
  SELECT table_id, col_idx, rank, value FROM cells WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY table_id, col_idx ORDER BY rank) <= 8
),
below AS (
  SELECT c.table_id, c.rank, c.col_idx, list(v.value ORDER BY v.rank) AS vals
  FROM candidates c JOIN firsts v ON v.table_id = c.table_id AND v.col_idx = c.col_idx AND v.rank > c.rank
  GROUP BY ALL
),
joined AS (
  SELECT c.*, coalesce(b.vals[1:3], []) AS vals FROM candidates c LEFT JOIN below b USING (table_id, rank, col_idx)
),
head_cells AS (
  SELECT table_id, rank, col_idx, name, CASE WHEN name = '' THEN 0 ELSE greatest(0, least(10,
      (CASE WHEN length(name) BETWEEN 2 AND 50 THEN 3 WHEN length(name) > 50 THEN -2 ELSE 0 END)
    + (CASE WHEN {alpha('name')} THEN 4 ELSE 0 END)
    + (CASE WHEN {header_word('name')} THEN 2 ELSE 0 END)
    + (CASE WHEN {has('name', 'id', 'name', 'date', 'value', 'code', 'type')} THEN 1 ELSE 0 END)
    - (CASE WHEN {digits('name')} THEN 3 ELSE 0 END)
    + (CASE WHEN len(vals) = 0 THEN 0
        WHEN {has('name', 'date', 'time')} AND len(list_filter(vals, lambda x: {is_date('x')})) = len(vals) THEN 2
        WHEN {has('name', 'amount', 'value', 'count', 'number', 'price', 'cost')}
          AND len(list_filter(vals, lambda x: {is_number('x')})) = len(vals) THEN 1
        WHEN {has('name', 'id', 'key', 'code')}
          AND list_avg(list_transform(vals, lambda x: length(x))) BETWEEN 2 AND 20 THEN 1 ELSE 0 END)
    )) END AS tenths
  FROM joined
),
head_rows AS (
  SELECT table_id, rank, count(*) AS ncols,
    least(sum(tenths) + sum(CASE WHEN tenths > 3 OR (tenths = 3 AND length(name) > 50) THEN 2 ELSE 0 END)
      + sum(CASE WHEN name <> '' THEN 1 ELSE 0 END), 10 * count(*)) AS points
  FROM head_cells GROUP BY table_id, rank
),
best_rows AS (
  SELECT * FROM head_rows
  QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY points DESC, rank) = 1
),
headed AS (
  SELECT table_id, points > 3 * ncols AS has_headers,
    CASE WHEN points > 3 * ncols THEN rank END AS header_row,
    CASE WHEN points > 3 * ncols THEN CAST(points AS DOUBLE) / (10 * ncols) ELSE 3e-1 END AS header_score,
    CASE WHEN points > 3 * ncols THEN
      (CASE WHEN points > 8 * ncols THEN 'High' WHEN points > 6 * ncols THEN 'Moderate' ELSE 'Low' END)
      || ' quality headers detected (row ' || rank || ')' ELSE 'No clear header row detected' END AS header_reason
  FROM best_rows
)"""

CONFIDENCE = """gated AS (
  SELECT table_id, nrows, ncols, CASE WHEN nrows < 5 THEN 'Too few rows: ' || nrows || ' < 5'
    WHEN ncols < 2 THEN 'Too few columns: ' || ncols || ' < 2' END AS gate_reason
  FROM tabs
),
parts AS (
  SELECT g.*, d.density_reasons, header_reason, consistency_reason, has_headers, header_row,
    CASE WHEN gate_reason IS NULL THEN density_score ELSE 0e0 END AS density_score,
    CASE WHEN gate_reason IS NULL THEN header_score ELSE 0e0 END AS header_score,
    CASE WHEN gate_reason IS NULL THEN coalesce(consistency_score, 0e0) ELSE 0e0 END AS consistency_score
  FROM gated g LEFT JOIN dense d USING (table_id) LEFT JOIN headed h USING (table_id)
  LEFT JOIN consistent c USING (table_id)
),
judged AS (
  SELECT *, density_score * 4e-1 + header_score * 3e-1 + consistency_score * 3e-1 AS overall,
    CASE WHEN gate_reason IS NOT NULL THEN [gate_reason] ELSE
      list_concat(density_reasons, [header_reason, coalesce(consistency_reason, 'No data columns to analyze')]) END AS reasons
  FROM parts
)"""


def with_corpus(sheets: tuple[Sheet, ...], *parts: str, query: str) -> str:
    return "WITH " + ",\n".join([grid_sql(sheets), *parts]) + "\n" + query


ALL_PARTS = (COLUMNS, TABLES, DENSITY, CONSISTENCY, HEADERS, CONFIDENCE)
