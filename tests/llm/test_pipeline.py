"""The corpus pipeline next to its plain form."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry_module
import corpus_pipeline
from gridsift.llm import catalog, mixing, pieces, quality_rules
from tests.conftest import SF
from tests.llm.helpers import by_id, documents, near_components, words


def test_stages_next_to_plain_forms(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        after.append(docs.collect())
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    quality, exact, near, mixed, encoded = after

    rows = by_id(quality_rules.quality(spark.read.parquet(f"{SF}/documents.parquet"), quality_rules.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))))
    left = {i: t for i, t in before.items() if rows[i]["kept"]}
    assert {r["doc_id"]: r["text"] for r in quality} == left and 0 < len(left) < len(before)

    groups = {}
    for i, t in left.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    left = {min(g)[1]: left[min(g)[1]] for g in groups.values()}
    assert {r["doc_id"]: r["text"] for r in exact} == left

    left = {i: left[i] for i, (_, c) in near_components(left).items() if i == c}
    assert {r["doc_id"]: r["text"] for r in near} == left and len(near) < len(exact)

    copies = Counter(r["doc_id"] for r in mixed)
    assert all(r["text"] == left[r["doc_id"]] for r in mixed) and max(copies.values()) <= 2
    frame = spark.createDataFrame(near, "doc_id long, text string, lang string, source string, n_chars long")
    counts = by_id(mixing.mix(frame))
    assert copies == {i: r["copies"] for i, r in counts.items() if r["copies"]}
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += len(words(r["text"]))
    longest = {r["source"]: max(len(words(x["text"])) for x in near if x["source"] == r["source"]) for r in near}
    for r in near:
        assert abs(taken[r["source"]] - counts[r["doc_id"]]["target"]) <= longest[r["source"]]

    lattice = pieces.Lattice(catalog.tokenizer("piece_bpe_32k.model"))
    assert Counter(r["doc_id"] for r in encoded) == copies
    for r in encoded:
        data, _ = lattice.decode(np.array(r["ids"]), np.array([len(r["ids"])]))
        assert data.tobytes().decode() == left[r["doc_id"]]
        ids, _ = lattice.encode(pa.array([left[r["doc_id"]]]), np.array([r["doc_id"]]))
        assert r["ids"] == ids.tolist() and r["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())


def test_run_is_registered(spark):
    rows = entry_module.queries()["pipeline"](spark, SF)
    assert rows.count() > 100
    assert {n.split("_")[0] for n in entry_module.queries()} >= {f"op{n}" for n in range(1, 11)}


def test_stages_on_no_rows_and_odd_rows(spark, tmp_path):
    for empty in (True, False):
        docs = documents(spark, empty=empty).select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert bool(docs.count()) != empty
