"""Classes of texts with equal sets."""

import pyarrow as pa

from gridsift.llm import minhash
from tests.llm.helpers import BASE


def test_equal_sets_in_different_slices_form_one_class():
    digests = set()
    for k in range(40):
        texts = [*(" ".join(f"p{k}x{i}y{j}" for i in range(9 + k)) for j in range(k)), BASE]
        batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
        for part in minhash._profiles(minhash.ROWS, minhash.BANDS)(iter([batch])):
            last = part.slice(part.num_rows - 1).to_pylist()[0]
            digests.add((last["same_length"], last["digest"], last["same_hash"]))
    assert len(digests) == 1


def test_a_document_of_several_texts_links_their_classes(spark):
    other = " ".join(f"z{i}" for i in range(90))
    docs = spark.createDataFrame([(1, BASE), (2, BASE), (2, other), (3, other), (4, "alone")], "doc_id long, text string")
    rows = minhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]
