"""A corpus run: quality rules, exact and near duplicates, mixing, and encoding.

Each stage takes all that the one before kept.  All but the last return the columns
of ``documents``; the mix repeats a document as often as it takes it whole.
"""

from __future__ import annotations

from gridsift.llm import exact_dedup, minhash, mixing, pieces, quality_rules
from gridsift.llm.catalog import table, tokenizer
from gridsift.llm.shared import saved


def passing_quality(spark, docs, sf_dir):
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark, docs, sf_dir):
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark, docs, sf_dir):
    return minhash.drop_near_duplicates(docs)


def mixed(spark, docs, sf_dir):
    return mixing.repeat_documents(docs)


def encoded(spark, docs, sf_dir):
    return pieces.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", passing_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("sampled pieces", encoded),
]
#: SQL cannot say the model of the first stage or the draws of the last; tests/llm has the plain form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
