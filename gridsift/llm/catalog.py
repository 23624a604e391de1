"""The queries of the operators, each with its SQL form where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm import bpe, exact_dedup, language, minhash, mixing, negatives, pieces, quality_gam, quality_rules, secrets, token_files, warc, whitening
from gridsift.llm.shared import new_folder
from gridsift.session import delete_at_end

QUERIES, SQL = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where the installed vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


@query()
def op1_token_files(spark, sf_dir):
    folder = new_folder(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer("word_bpe_49k.json"))
    delete_at_end(spark, folder)
    return token_files.token_table(spark, folder)


@query("""
WITH d AS (SELECT doc_id, coalesce(source IS NULL, false) AS none, coalesce(source, '') AS name,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT none, name, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
r AS (SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY none, name) - 1) % 3 + 1)::INT] AS BIGINT) AS w, source_size * 2 AS cap FROM s),
o AS (SELECT *, CAST(coalesce(sum(cap) OVER before, 0) AS BIGINT) AS caps, CAST(coalesce(sum(w) OVER before, 0) AS BIGINT) AS ws,
    1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS pool, CAST(sum(w) OVER () AS BIGINT) AS weights
    FROM r WINDOW before AS (ORDER BY cap::DOUBLE / w::DOUBLE, none, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * (weights - ws) <= w * (pool - caps) AS at_limit FROM o),
u AS (SELECT CAST(coalesce(sum(cap) FILTER (at_limit), 0) AS BIGINT) AS used, CAST(sum(w) FILTER (NOT at_limit) AS BIGINT) AS open FROM f),
t AS (SELECT none, name, source_size, CASE WHEN at_limit THEN cap::DOUBLE ELSE w * (pool - used) / open END AS target FROM f, u),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
    CAST(coalesce(sum(size) OVER (PARTITION BY none, name ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM d JOIN t USING (none, name)),
q AS (SELECT *, CAST(floor(target) AS BIGINT) - epochs * source_size - before AS rest FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest)) AS BIGINT) AS taken,
    CAST(epochs + CASE WHEN rest > 0 AND 2 * rest >= size THEN 1 ELSE 0 END AS BIGINT) AS copies FROM q""")
def op2_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query(r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS gs FROM w),
s AS (SELECT doc_id, unnest(gs) AS shingle FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN g gx ON gx.doc_id = x JOIN g gy ON gy.doc_id = y WHERE 100 * shared >= 75 * (len(gx.gs) + len(gy.gs) - shared)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x AS a, x AS b FROM l UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
c AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT g.doc_id, len(gs) AS n_shingles, coalesce(component, g.doc_id) AS component_id, coalesce(component, g.doc_id) = g.doc_id AS kept FROM g LEFT JOIN c ON c.a = g.doc_id""")
def op3_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to, true AS intact FROM f""")
def op4_warc_archives(spark, sf_dir):
    folder = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    delete_at_end(spark, folder)
    return warc.record_table(warc.read_chunks(spark, folder, with_data=False))


@query()
def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


@query()
def op6_secret_scan(spark, sf_dir):
    return secrets.secrets(table(spark, sf_dir, "documents"))


@query()
def op7_quality_scores(spark, sf_dir):
    return quality_gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
h AS (SELECT doc_id, sha256(norm) AS text_sha256, length(t) AS n FROM d),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


@query()
def op9_sampled_pieces(spark, sf_dir):
    model = tokenizer("piece_bpe_32k.model")
    rows = pieces.encode(table(spark, sf_dir, "documents"), model)
    back = pieces.decode(rows, model, keep=["n_pieces", "ids_crc32", "ids"])
    return back.select("doc_id", "n_pieces", "ids_crc32", F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"), "ids")


@query()
def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.languages(docs, language.train(docs))


@query()
def op11_whitening(spark, sf_dir):
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query()
def op12_byte_bpe(spark, sf_dir):
    path = tokenizer("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path, keep=["n_tokens", "ids"])
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", "n_tokens", F.sha2(said.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT)) AS x FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
u AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM v WHERE len(x) = (SELECT len(x) FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
s AS (SELECT a.k AS a, a.id AS anchor_id, b.k AS b, b.id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM u a JOIN u b ON a.id % 100 = 0 AND a.k <> b.k),
p AS (SELECT a, anchor_id, b, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label))
