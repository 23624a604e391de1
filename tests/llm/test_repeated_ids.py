"""Rows without an id, and rows of one id, in the mix."""

from collections import Counter

from gridsift.llm import mixing

IDS = [None, None, None, 5, 5, 5, 1, 2, 3, 4]


def test_each_row_meets_its_own_copies(spark):
    # Sizes differ, so a text's copies can be told from the rows of the mix.
    rows = [(i, " ".join([f"w{k}"] * (k + 1)), f"s{k % 2}") for k, i in enumerate(IDS * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = {r["size"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert len(want) == len(rows) and set(want.values()) <= {0, 1, 2}
    found = mixing.repeat_documents(docs)
    assert found.columns == docs.columns
    got = Counter(tuple(r) for r in found.collect())
    assert got == Counter({r: want[len(r[1].split())] for r in rows if want[len(r[1].split())]})
