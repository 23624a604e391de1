"""The sampled pieces query returns its ids, and texts that come from them."""

import zlib

import numpy as np

from gridsift.llm import catalog, pieces
from tests.conftest import SF
from tests.llm.helpers import by_id


def test_the_query_returns_ids_that_decode(spark, monkeypatch):
    monkeypatch.setattr(pieces, "DECODED_IDS", 1000)
    rows = catalog.QUERIES["op9_sampled_pieces"](spark, SF)
    assert rows.columns == ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "ids"]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found, back = by_id(rows), by_id(pieces.decode(rows, catalog.tokenizer("piece_bpe_32k.model")))
    assert found.keys() == texts.keys()
    for i, r in found.items():
        assert r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert back[i]["text"] == texts[i] and r["decoded_crc32"] == zlib.crc32(texts[i].encode())
