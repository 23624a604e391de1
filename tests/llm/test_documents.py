"""Operators on whole texts, against plain forms."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridsift.llm import catalog, exact_dedup, minhash, mixing, token_files, warc, words as W
from gridsift.llm.shared import new_folder
from tests.conftest import SF
from tests.llm.helpers import BASE, TEXTS, by_id, documents, near_components, words


def test_words_and_windows():
    arr = pa.array([*TEXTS, *TEXTS]).slice(3)
    found = W.find_words(*W.text_buffers(arr))
    for k, text in enumerate(arr.to_pylist()):
        own = [bytes(found.data[found.starts[i] : found.ends[i]]).decode() for i in range(found.first[k], found.first[k + 1])]
        assert own == words(text)
    sizes = minhash.shingle_sets(arr)[1]
    from tests.llm.helpers import shingles

    assert sizes.tolist() == [len(shingles(t)) for t in arr.to_pylist()]


def test_small_slices_cover_all_rows():
    batch = pa.record_batch([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["a", "b"])
    parts = list(W.small_slices(batch, 1, 1000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(TEXTS))) and len(parts) > 3


@pytest.mark.parametrize("repeat", [False, True])
def test_exact_copies(spark, repeat):
    docs = documents(spark, repeat=repeat)
    rows = exact_dedup.copies(docs, runs=8, fan_in=2).collect()
    source = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = {}
    for i, text in source:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), i))
    want = sorted((i, min(groups[n])[1], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t in source for n in [re.sub(r"[\x20\x09-\x0D]", "", t)])
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(groups)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(min(g)[1] for g in groups.values())


def test_exact_copies_with_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, "ab"), (3, "a  b"), (None, "z")], "doc_id long, text string")
    rows = exact_dedup.copies(docs).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (-1, 3, False), (3, 3, True), (7, 3, False)]
    assert exact_dedup.copies(documents(spark, empty=True)).count() == 0
    assert exact_dedup.drop_copies(documents(spark, empty=True)).count() == 0


def test_a_large_group_in_many_runs(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN concat('sa', repeat(' ', cast(id % 2 as int)), 'me') ELSE cast(id AS string) END AS text").repartition(16)
    rows = by_id(exact_dedup.copies(docs, runs=16, fan_in=4))
    assert rows[9]["keep_id"] == 3 and rows[9]["group_size"] == 1000 and rows[3]["kept"] and not rows[0]["kept"]
    assert rows[1]["group_size"] == 1


def test_mix(spark):
    docs = documents(spark, TEXTS * 6)
    rows = by_id(mixing.mix(docs))
    info = {r["doc_id"]: r for r in docs.collect()}
    totals = {}
    for i, r in rows.items():
        assert r["size"] == len(words(info[i]["text"])) and 0 <= r["taken"] <= 2 * r["size"] and 0 <= r["copies"] <= 2
        x = totals.setdefault(info[i]["source"], [0, 0, r["target"], r["source_size"]])
        x[0] += r["size"]
        x[1] += r["taken"]
    assert len(totals) == 4
    for size, taken, target, stated in totals.values():
        assert size == stated and taken == int(target) and target <= 2 * size
    assert abs(sum(x[2] for x in totals.values()) - 1.5 * sum(x[0] for x in totals.values())) < 1e-6
    weights = {s: w for s, w in zip(sorted(totals, key=lambda s: (s is None, s or "")), (3, 1, 2, 3), strict=True)}
    level = [totals[s][2] / w for s, w in weights.items() if totals[s][2] < 2 * totals[s][3]]
    assert max(level) - min(level) < 1e-6 * max(level)
    assert by_id(mixing.mix(docs.repartition(5))) == rows


def test_mix_without_words_or_rows(spark):
    assert mixing.mix(documents(spark, empty=True)).count() == 0
    docs = spark.createDataFrame([(1, None, "a"), (2, "x y", "b"), (3, "", "a"), (None, "z", None)], "doc_id long, text string, source string")
    rows = by_id(mixing.mix(docs))
    assert rows[1]["target"] == 0 and rows[1]["taken"] == 0 and rows[2]["source_size"] == 2
    mixed = mixing.repeat_documents(documents(spark))
    assert mixed.columns == documents(spark).columns


def test_near_duplicates(spark):
    docs = documents(spark, TEXTS + [BASE.upper(), BASE + " tail"], repeat=True)
    want = near_components({r["doc_id"]: r["text"] for r in docs.collect()})
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    left = minhash.drop_near_duplicates(docs)
    assert {r["doc_id"] for r in left.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert minhash.near_duplicates(documents(spark, empty=True)).count() == 0
    alone = minhash.near_duplicates(spark.createDataFrame([(None, BASE), (4, BASE)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in alone) == [(-1, -1, True), (4, 4, True)]


def test_near_duplicates_in_chains_and_crowds(spark):
    """Chains whose ends are far apart, and texts that share half their words with all others."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(6):
        chain = [f"c{rng.integers(1 << 40)}" for _ in range(200)]
        for step in range(8):
            texts.append(" ".join(chain))
            at = int(rng.integers(0, 180))
            chain[at : at + 12] = [f"c{rng.integers(1 << 40)}" for _ in range(12)]
    common = [f"p{i}" for i in range(60)]
    texts += [" ".join([*common, *(f"u{rng.integers(1 << 40)}" for _ in range(int(rng.integers(5, 60))))]) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_components(dict(enumerate(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == want


def test_sketch_is_filled_and_tells_the_similarity():
    a, b = (np.unique(W.seeded(np.arange(x, x + 600, dtype=np.uint64), 5)) for x in (0, 100))
    sizes = np.array([600, 600, 1, 0])
    sketch = minhash.sketches(np.concatenate([a, b, a[:1]]), sizes, 1000)
    assert (sketch[:3] != minhash.EMPTY).all() and (sketch[3] == minhash.EMPTY).all()
    assert abs((sketch[0] == sketch[1]).mean() - 500 / 700) < 0.06


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(catalog.tokenizer("word_bpe_49k.json"))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_token_files(spark):
    docs = documents(spark, repeat=True)
    folder = new_folder(spark, "test")
    token_files.write_token_files(docs, folder, catalog.tokenizer("word_bpe_49k.json"))
    source = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None) + [(0, None)]
    source = sorted(source, key=lambda x: x[0])
    ids = {i: x for (i, _), x in zip(source, encoded([t for _, t in source]), strict=True)}
    assert all(r["ids"] == ids[r["doc_id"]] for r in token_files.read_token_files(spark, folder).collect())
    rows = sorted(token_files.token_table(spark, folder).collect(), key=lambda r: (r["start"]))
    start = 0
    assert [r["doc_id"] for r in rows] == [i for i, _ in source]
    for r in rows:
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    empty = new_folder(spark, "test")
    token_files.write_token_files(documents(spark, empty=True), empty, catalog.tokenizer("word_bpe_49k.json"))
    assert token_files.token_table(spark, empty).count() == 0


def test_blocks_of_wide_ranks():
    ids = np.concatenate([np.arange(70000), np.zeros(5)]).astype(np.uint32)
    block = token_files.pack_block(ids, np.array([5, 9]), np.array([False, True]), np.array([70000, 5]), 3, 1) + b"\n"
    part, number, doc_ids, no_id, counts, back = next(token_files.unpack_blocks(memoryview(block)))
    assert (part, number, doc_ids.tolist(), no_id.tolist(), counts.tolist()) == (3, 1, [5, 9], [0, 1], [70000, 5]) and (back == ids).all()


PAGES = [(0, "http://a/b c", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "u", None), (3, "u", ""), (4, "u\r\nv", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 3),
         (5, "u", "é" * 900_000), (6, "u", "y" * (1 << 20)), (7, "u", "é" * 900_000), (None, "n", "<p>x</p>"), (8, "u", "z" * (1 << 16))]


@pytest.mark.parametrize("least", [0, 100])
def test_archives(spark, least):
    folder = new_folder(spark, "test")
    pages = spark.createDataFrame([(*p, 1, "c") for p in PAGES] + [(*PAGES[0], 2, "d")], "page_id long, url string, html string, run int, page string").repartition(3)
    warc.write_archives(pages, folder, least=least)
    chunks = warc.read_chunks(spark, folder)
    rows = warc.record_table(chunks).collect()
    assert len(rows) == len(PAGES) + 1 and all(r["intact"] for r in rows)
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first.setdefault(html or "", i)
    seen = set()
    for r in sorted(rows, key=lambda r: (r["page_id"] is None, r["page_id"], r["record_type"])):
        payload = next(html or "" for i, _, html in PAGES if i == r["page_id"])
        raw = payload.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        again = len(raw) >= least and (first[payload] != r["page_id"] or r["page_id"] in seen)
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[payload]) if again else ("response", None))
        seen.add(r["page_id"])
    data = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["record"], r["chunk"])):
        assert len(r["data"]) <= warc.CHUNK
        data.setdefault((r["page"], r["record_type"], r["record"]), []).append(bytes(r["data"]))
    for (page, kind, _), parts in data.items():
        if kind == "response":
            assert b"".join(parts) == next((html or "").encode() for i, _, html in PAGES if i == page)


def test_many_pages_without_id(spark):
    """Rows of one id, with payloads of their own and repeated ones, in time by their number."""
    import time

    took = {}
    for n in (2000, 20000):
        rows = spark.range(n).selectExpr("CAST(NULL AS BIGINT) AS page_id", "'u' AS url", "concat('<p>', id % 1500, '</p>') AS html")
        rows = rows.unionByName(spark.createDataFrame([(7, "v", "<p>3</p>"), (9, "v", "<p>3</p>")], "page_id long, url string, html string"))
        folder, start = new_folder(spark, "test"), time.perf_counter()
        warc.write_archives(rows, folder)
        found = warc.record_table(warc.read_chunks(spark, folder, with_data=False)).collect()
        took[n] = time.perf_counter() - start
        assert len(found) == n + 2 and all(r["intact"] for r in found)
        assert sum(r["record_type"] == "response" for r in found) == 1500
        assert {r["refers_to"] for r in found if r["page_id"] == 9} == {7}
        # A null id is the last to be the response of a payload.
        assert sum(r["page_id"] is None and r["refers_to"] == 7 for r in found) == len([k for k in range(n) if k % 1500 == 3])
    names = [r["record"] for r in warc.read_chunks(spark, folder, with_data=False).where("chunk = 0").collect()]
    assert len(set(names)) == len(names) and took[20000] < 5 * took[2000] + 10


def test_no_pages(spark):
    folder = new_folder(spark, "test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.record_table(warc.read_chunks(spark, folder)).count() == 0


def test_whole_table_of_tokens(spark):
    rows = by_id(catalog.QUERIES["op1_token_files"](spark, SF))
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    start = 0
    for (i, _), ids in zip(docs, encoded([t for _, t in docs]), strict=True):
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
