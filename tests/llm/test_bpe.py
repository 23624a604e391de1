"""Byte-level BPE next to the library that the vocabulary file is made for."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridsift.llm import bpe, catalog
from tests.llm.helpers import TEXTS, by_id, documents

PATH = catalog.tokenizer("byte_bpe_50k.json")
ODD = [
    "it's don't 'sx \n'sa  'll x's's ''s ' we'RE I'd'd", "a<|endoftext|>b <|endoftext|><|endoftext|> '<|endoftext|>'s <|endoftext", "  a\n\n b\t\tc\xa0　d e  \n",
    "né è 東京 😀😀 ٣² Ⅷ", "x" * 3000 + " " * 3000 + "1" * 3000 + "!?" * 1000, "\r\n\r\n x\x00\x01\x7f",
]


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def compare(own, library, texts):
    ids, counts = own.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    data, edges = own.decode(ids, counts)
    raw = data.tobytes()
    for k, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[ends[k] - counts[k] : ends[k]].tolist() == want
        assert raw[edges[k] : edges[k + 1]].decode() == library.decode(want, skip_special_tokens=False)


def test_texts(own, library):
    compare(own, library, [*TEXTS, *ODD])
    compare(own, library, [])


def test_signs_of_every_class(own, library):
    """The signs at both ends of each run of signs of one class, in all surroundings."""
    edges = np.flatnonzero(np.diff(own.classes.astype(int)))
    signs = [chr(c) for e in edges.tolist() for c in (e, e + 1) if not 0xD800 <= c < 0xE000]
    compare(own, library, [f"{c}a {c}1{c}!{c} {c}{c} x{c}" for c in signs])


def test_made_up_texts(own, library):
    rng = random.Random(3)
    parts = [" ", " ", "'", "s", "t", "re", "ll", "ve", "d", "m", "a", "B", "1", "!", "\n", "\t", "\xa0", "é", "東", "<|endoftext|>", "<|", "'S", "٣", "\r\n", "²", "́", "😀"]
    compare(own, library, ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(8000)])


def test_merges_step_by_step_and_by_heap_agree(own):
    rng = random.Random(4)
    fragments = ["".join(rng.choices("etaoin shrdlu", k=rng.randrange(1, 33))).encode() for _ in range(3000)]
    ids, counts = own.merged_many(fragments)
    at = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [own.merged(f) for f in fragments]


def test_no_token_has_a_certain_cut_inside(own):
    assert own.cut[ord("a") * 256 + ord(" ")] and not own.cut[ord("t") * 256 + ord("h")]
    for token in own.token[:50256]:
        assert not any(own.cut[a * 256 + b] for a, b in zip(token, token[1:], strict=False))


def test_forgetting_and_equal_hashes_change_nothing(own, library, monkeypatch):
    fresh = bpe.Bpe(PATH)
    monkeypatch.setattr(bpe, "KEPT", 3)
    compare(fresh, library, ODD)
    compare(fresh, library, TEXTS[3:12])
    monkeypatch.setattr(bpe, "span_hashes", lambda raw, starts, ends: (starts % 3).astype(np.uint64))
    compare(fresh, library, ODD)


@pytest.mark.parametrize("repeat", [False, True])
def test_rows(spark, library, repeat):
    docs = documents(spark, [*TEXTS, *ODD], repeat=repeat)
    rows = bpe.encode(docs, PATH)
    back = bpe.decode(rows, PATH, keep=["n_tokens", "ids"])
    assert rows.count() == back.count() == docs.count()
    texts, found = by_id(docs), by_id(back)
    for i, r in found.items():
        assert r["ids"] == library.encode(texts[i]["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["text"] == (texts[i]["text"] or "")
    assert bpe.decode(bpe.encode(documents(spark, empty=True), PATH), PATH).count() == 0
    no_ids = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in bpe.encode(no_ids, PATH).collect()) == [0, 2]
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first()["text"] == ""


def test_query(spark, library, tmp_path):
    documents(spark, [*TEXTS, *ODD]).write.parquet(f"{tmp_path}/documents.parquet")
    found = by_id(catalog.QUERIES["op12_byte_bpe"](spark, str(tmp_path)))
    for i, t in enumerate([*TEXTS, *ODD]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(found[i])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
