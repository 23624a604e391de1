"""Queries on scores and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.catalog import query
from gridsift.catalog import sql as Q
from gridsift.catalog.corpora import DIRTY, SHEETS, sources_of
from gridsift.catalog.shaping import CELLS
from gridsift.operators import confidence as C
from gridsift.operators import consistency as K
from gridsift.operators import density as D
from gridsift.operators import headers as H
from gridsift.operators.profile import distinct_counts


def _known(spark, sf_dir, sheets=DIRTY):
    return C.profile(sources_of(spark, sf_dir, sheets))


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


@query(Q.with_corpus(CELLS, Q.COLUMNS, Q.CONSISTENCY, query="""
SELECT table_id, col_idx, n, numbers, round(numeric_score, 6) AS numeric_score FROM graded"""))
def numeric_consistency(spark, sf_dir):
    scored = K.numeric_consistency(_known(spark, sf_dir, CELLS).columns)
    return _rounded(scored.select("table_id", "col_idx", "n", "numbers", "numeric_score"), "numeric_score")


@query(Q.with_corpus(CELLS, Q.COLUMNS, Q.CONSISTENCY, query="""
SELECT table_id, col_idx, n, dates, round(date_score, 6) AS date_score FROM graded"""))
def date_consistency(spark, sf_dir):
    scored = K.date_consistency(_known(spark, sf_dir, CELLS).columns)
    return _rounded(scored.select("table_id", "col_idx", "n", "dates", "date_score"), "date_score")


@query(Q.with_corpus(CELLS, Q.COLUMNS, Q.CONSISTENCY, query="""
SELECT table_id, col_idx, distinct_values, round(categorical_score, 6) AS categorical_score FROM graded"""))
def categorical_consistency(spark, sf_dir):
    known = _known(spark, sf_dir, CELLS)
    counts = distinct_counts(known.grid, known.columns.select("table_id", "col_idx"), known.sources)
    scored = K.categorical_consistency(known.columns.join(counts, ["table_id", "col_idx"]))
    return _rounded(scored.select("table_id", "col_idx", "distinct_values", "categorical_score"), "categorical_score")


@query(Q.with_corpus(CELLS, Q.COLUMNS, Q.CONSISTENCY, query="""
SELECT table_id, col_idx, round(column_score, 6) AS column_score FROM scored"""))
def column_consistency(spark, sf_dir):
    known = _known(spark, sf_dir, CELLS)
    scored = K.score_columns(known.grid, known.columns, known.sources)
    return _rounded(scored.select("table_id", "col_idx", "column_score"), "column_score")


@query(Q.with_corpus(CELLS, Q.COLUMNS, Q.CONSISTENCY, query="""
SELECT table_id, round(consistency_score, 6) AS consistency_score, consistency_reason FROM consistent"""))
def table_consistency(spark, sf_dir):
    known = _known(spark, sf_dir, CELLS)
    scored = K.table_consistency(K.score_columns(known.grid, known.columns, known.sources))
    return _rounded(scored.select("table_id", "consistency_score", "consistency_reason"), "consistency_score")


@query(Q.with_corpus(DIRTY, Q.TABLES, Q.DENSITY, query="""
SELECT table_id, round(clustering_score, 6) AS clustering_score, round(bonus, 6) AS clustering_bonus FROM bonused"""))
def clustering_bonus(spark, sf_dir):
    scored = D.clustering_bonus(_known(spark, sf_dir).tables)
    return _rounded(
        scored.select("table_id", "clustering_score", "clustering_bonus"), "clustering_score", "clustering_bonus"
    )


@query(Q.with_corpus(DIRTY, Q.TABLES, Q.DENSITY, query="""
SELECT table_id, round(density, 6) AS density, round(density_score, 6) AS density_score,
  array_to_string(density_reasons, ' / ') AS density_reasons FROM dense"""))
def density_score(spark, sf_dir):
    scored = D.density_score(_known(spark, sf_dir).tables)
    scored = scored.withColumn("density_reasons", F.array_join("density_reasons", " / "))
    return _rounded(scored, "density", "density_score")


def _cells(known):
    return H.header_cells(known.grid, known.columns, known.top, known.sources)


@query(Q.with_corpus(CELLS, Q.HEADERS, query="""
SELECT table_id, rank, col_idx, name, tenths FROM head_cells"""))
def header_cells(spark, sf_dir):
    return _cells(_known(spark, sf_dir, CELLS)).select("table_id", "rank", "col_idx", "name", "tenths")


@query(Q.with_corpus(CELLS, Q.HEADERS, query="""
SELECT table_id, rank, CAST(points AS BIGINT) AS points, round(CAST(points AS DOUBLE) / (10 * ncols), 6) AS score
FROM head_rows"""))
def header_rows(spark, sf_dir):
    rows = H.header_rows(_cells(_known(spark, sf_dir, CELLS)))
    return _rounded(rows.select("table_id", "rank", "points", "score"), "score")


@query(Q.with_corpus(CELLS, Q.HEADERS, query="""
SELECT table_id, rank, CAST(points AS BIGINT) AS points FROM best_rows"""))
def best_header_row(spark, sf_dir):
    rows = H.header_rows(_cells(_known(spark, sf_dir, CELLS)))
    return H.best_header_row(rows).select("table_id", "rank", "points")


def _quality(known):
    return H.header_quality(H.best_header_row(H.header_rows(_cells(known))))


@query(Q.with_corpus(CELLS, Q.HEADERS, query="""
SELECT table_id, has_headers, header_row, round(header_score, 6) AS header_score, header_reason FROM headed"""))
def header_quality(spark, sf_dir):
    return _rounded(_quality(_known(spark, sf_dir, CELLS)), "header_score")


@query(Q.with_corpus(CELLS, Q.HEADERS, query="""
SELECT table_id, has_headers, round(header_score, 6) AS header_quality,
  coalesce((SELECT string_agg(name, '|' ORDER BY col_idx) FROM head_cells c
    WHERE c.table_id = h.table_id AND h.has_headers AND c.rank = h.header_row), '') AS column_names
FROM headed h"""))
def header_names(spark, sf_dir):
    known = _known(spark, sf_dir, CELLS)
    cells = _cells(known)
    quality = H.header_quality(H.best_header_row(H.header_rows(cells)))
    names = H.header_names(cells, quality).withColumn("column_names", F.array_join("column_names", "|"))
    return _rounded(names.drop("header_row"), "header_quality")


TWO = f"""two AS (
  SELECT table_id, col_idx, max(value) FILTER (WHERE rank = 0) AS v0, max(value) FILTER (WHERE rank = 1) AS v1,
    count(*) FILTER (WHERE rank = 1) AS second
  FROM cells WHERE rank < 2 GROUP BY table_id, col_idx
),
rule AS (
  SELECT table_id,
    avg(CASE WHEN v0 IS NOT NULL AND {Q.strip('v0')} <> '' THEN 1e0 ELSE 0e0 END) AS text_ratio,
    avg(CASE WHEN v0 IS NOT NULL AND v1 IS NOT NULL AND NOT {Q.digits('v0')} AND {Q.digits('v1')} THEN 1e0 ELSE 0e0 END) AS change_ratio,
    sum(CASE WHEN v0 IS NOT NULL AND {Q.strip('v0')} <> '' THEN 1 ELSE 0 END) AS texts0,
    sum(CASE WHEN v1 IS NOT NULL AND {Q.strip('v1')} <> '' THEN 1 ELSE 0 END) AS texts1,
    count(*) AS ncols, max(second) AS second
  FROM two GROUP BY table_id
)"""


@query(Q.with_corpus(DIRTY, TWO, query="""
SELECT table_id, round(text_ratio, 6) AS text_ratio, round(change_ratio, 6) AS change_ratio,
  text_ratio > 6e-1 OR change_ratio > 3e-1 AS is_header FROM rule"""))
def first_row_header(spark, sf_dir):
    return _rounded(H.first_row_is_header(_known(spark, sf_dir).top), "text_ratio", "change_ratio")


@query(Q.with_corpus(DIRTY, TWO, query="""
SELECT table_id, second > 0 AND texts0 >= ncols * 5e-1 AND texts1 < texts0 AS has_headers FROM rule"""))
def has_headers_simple(spark, sf_dir):
    return H.has_headers_simple(_known(spark, sf_dir).top)


@query(Q.with_corpus(DIRTY, Q.TABLES, query="""
SELECT table_id, nrows AS "rows", ncols AS "columns", CASE WHEN nrows < 60 THEN 'Too few rows: ' || nrows || ' < 60'
  WHEN ncols < 5 THEN 'Too few columns: ' || ncols || ' < 5' END AS gate_reason FROM tabs"""))
def gate(spark, sf_dir):
    settings = C.ScoreSettings(min_rows=60, min_columns=5)
    return C.gate(_known(spark, sf_dir).tables, settings)


_SCORES = """
SELECT table_id, nrows AS "rows", ncols AS "columns", round(density_score, 6) AS density_score,
  round(header_score, 6) AS header_score, round(consistency_score, 6) AS consistency_score,
  round(overall, 6) AS overall, round(overall, 12) >= 7e-1 AS accepted,
  coalesce(gate_reason IS NULL AND has_headers, false) AS has_headers,
  CASE WHEN gate_reason IS NULL THEN header_row END AS header_row,
  array_to_string(reasons, ' / ') AS reasons
FROM judged"""


def _scores(spark, sf_dir, sheets):
    scores = C.confidence(sources_of(spark, sf_dir, sheets))
    scores = scores.withColumn("reasons", F.array_join("reasons", " / "))
    return _rounded(scores, "density_score", "header_score", "consistency_score", "overall")


@query(Q.with_corpus(SHEETS, *Q.ALL_PARTS, query=_SCORES))
def confidence_scores(spark, sf_dir):
    """Flagship: every flat table judged as a worksheet."""
    return _scores(spark, sf_dir, SHEETS)


@query(Q.with_corpus(DIRTY, *Q.ALL_PARTS, query=_SCORES))
def confidence_scores_dirty(spark, sf_dir):
    """Many worksheets with blanks, garbled cells and missing headers."""
    return _scores(spark, sf_dir, DIRTY)


@query(Q.with_corpus(DIRTY, *Q.ALL_PARTS, query="""
SELECT table_id, round(overall, 6) AS overall FROM judged WHERE round(overall, 12) >= 8e-1"""))
def accepted_tables(spark, sf_dir):
    """Worksheets that pass a stricter threshold."""
    scores = C.accepted(C.confidence(sources_of(spark, sf_dir, DIRTY)), 0.8)
    return _rounded(scores.select("table_id", "overall"), "overall")


@query(Q.with_corpus(DIRTY, *Q.ALL_PARTS, query="""
SELECT table_id, round(density_score * 6e-1 + header_score * 1e-1 + consistency_score * 3e-1, 6) AS overall,
  round(density_score * 6e-1 + header_score * 1e-1 + consistency_score * 3e-1, 12) >= 5e-1 AS accepted FROM judged"""))
def custom_weights(spark, sf_dir):
    """Scores under other weights and another threshold."""
    settings = C.ScoreSettings(threshold=0.5, density_weight=0.6, header_weight=0.1, consistency_weight=0.3)
    scores = C.confidence(sources_of(spark, sf_dir, DIRTY), settings)
    return _rounded(scores.select("table_id", "overall", "accepted"), "overall")


@query(Q.with_corpus(DIRTY, *Q.ALL_PARTS, query="""
SELECT table_id, unnest(range(1, len(reasons) + 1)) AS place, unnest(reasons) AS reason FROM judged"""))
def confidence_reasons(spark, sf_dir):
    """Reasons one by one, in order."""
    scores = C.confidence(sources_of(spark, sf_dir, DIRTY))
    reasons = scores.select("table_id", F.posexplode("reasons").alias("place", "reason"))
    return reasons.withColumn("place", (F.col("place") + 1).cast("long"))


@query(Q.with_corpus(DIRTY, *Q.ALL_PARTS, query="""
SELECT table_id, array_to_string(reasons[1:2], ' / ') AS reasons FROM judged"""))
def top_reasons(spark, sf_dir):
    top = C.top_reasons(C.confidence(sources_of(spark, sf_dir, DIRTY)), 2)
    return top.withColumn("reasons", F.array_join("reasons", " / "))


@query(Q.with_corpus(DIRTY, *Q.ALL_PARTS, query="""
SELECT table_id, printf('Overall Confidence: %.3f', overall) || chr(10) || printf('  Data Density: %.3f', density_score) || chr(10)
  || printf('  Header Quality: %.3f', header_score) || chr(10) || printf('  Data Consistency: %.3f', consistency_score) || chr(10)
  || chr(10) || 'Reasons:' || chr(10) || array_to_string(list_transform(reasons, lambda r: '  - ' || r || chr(10)), '')
  || chr(10) || 'Decision: ' || CASE WHEN round(overall, 12) >= 7e-1 THEN 'ACCEPT' ELSE 'REJECT' END AS summary
FROM judged"""))
def summary_text(spark, sf_dir):
    return C.summary_text(C.confidence(sources_of(spark, sf_dir, DIRTY)))


@query(Q.with_corpus(DIRTY, *Q.ALL_PARTS, query="""
SELECT table_id FROM judged WHERE NOT (overall BETWEEN 0 AND 1 AND density_score BETWEEN 0 AND 1
  AND header_score BETWEEN 0 AND 1 AND consistency_score BETWEEN 0 AND 1)"""))
def scores_out_of_range(spark, sf_dir):
    """Invariant: no score leaves [0, 1]."""
    return C.out_of_range(C.confidence(sources_of(spark, sf_dir, DIRTY))).select("table_id")


@query(Q.with_corpus(DIRTY, *Q.ALL_PARTS, query="""
SELECT j.table_id, j.nrows AS "rows", j.ncols AS "columns", round(d.density, 6) AS density, round(overall, 6) AS overall,
  CASE WHEN round(overall, 12) >= 7e-1 THEN 'ACCEPT' ELSE 'REJECT' END AS decision,
  array_to_string(reasons[1:3], ' / ') AS reasons,
  CASE WHEN round(overall, 12) >= 7e-1 THEN (
    SELECT string_agg(array_to_string(list_transform(cells, lambda c: coalesce(c, '~')), '|'), chr(10) ORDER BY rank)
    FROM grid g WHERE g.table_id = j.table_id AND g.rank < 5) END AS preview
FROM judged j JOIN dense d USING (table_id)"""))
def preview_report(spark, sf_dir):
    """The dry run: decision, reasons, and the first rows of accepted worksheets."""
    known = _known(spark, sf_dir)
    report = C.preview_report(known, C.confidence(known), 10)
    text = F.array_join(F.transform("preview", lambda r: F.array_join(r, "|", "~")), "\n")
    report = report.withColumn("reasons", F.array_join("reasons", " / ")).withColumn("preview", text)
    return _rounded(report, "density", "overall")
