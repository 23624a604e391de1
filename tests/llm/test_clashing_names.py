"""The stages that keep all columns, on tables whose columns have the names used inside."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from gridsift.llm import exact_dedup, minhash, mixing, quality_rules
from tests.conftest import SF
from tests.llm.helpers import words

NAMES = ["_row", "_copies", "_n", "_id", "_own", "_sha", "_ROW", "_salt", "_number", "_place", "id", "sha", "kept", "row", "key", "size", "b.c"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, ids):
    """Rows that can be told apart by ``mark``; some texts differ in white space only."""
    rows = []
    for k, i in enumerate(ids):
        text = " ".join(f"w{j % 97}x{k // 2}" for j in range(20 + k // 2)) + " " * (k % 2)
        rows.append((i, None if k == 7 else text, "en", None if k % 5 == 0 else f"s{k % 3}", k, *[777 + k] * len(NAMES)))
    names = SCHEMA + ", " + ", ".join(f"`{n}` long" for n in NAMES if n != "_ROW")
    rows = [r[: len(r) - 1] for r in rows]
    return spark.createDataFrame(rows, names).repartition(3), rows


IDS = [[*range(30)], [None, None, None, 5, 5, 5, *range(100, 124)]]


@pytest.mark.parametrize("ids", IDS)
def test_exact_dedup(spark, ids):
    docs, rows = table(spark, ids)
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, r))
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    got = Counter(tuple(r) for r in out.collect())
    assert got == Counter(min(g, key=lambda x: x[:3])[3] for g in groups.values())


@pytest.mark.parametrize("ids", IDS)
def test_mix(spark, ids):
    docs, rows = table(spark, ids)
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"], r["size"]] += r["copies"]
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert {tuple(r) for r in got} <= set(rows)
    assert Counter((r["doc_id"], len(words(r["text"]))) for r in got) == +copies


@pytest.mark.parametrize("ids", IDS)
def test_near_duplicates_and_quality(spark, ids):
    docs, rows = table(spark, ids)
    out = minhash.drop_near_duplicates(docs)
    gone = {r["doc_id"] for r in minhash.near_duplicates(docs).where("NOT kept").collect()}
    assert out.columns == docs.columns and sorted(map(str, map(tuple, out.collect()))) == sorted(str(r) for r in rows if r[0] not in gone)
    good = quality_rules.keep_good(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert good.columns == docs.columns and {tuple(r) for r in good.collect()} <= set(rows)


def test_all_stages_in_a_row(spark):
    docs, _ = table(spark, IDS[1])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
