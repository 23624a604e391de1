"""Queries of the operators next to their SQL forms, on whole tables."""

import duckdb
import pytest

from gridsift.llm import catalog
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_every_operator_has_one_query():
    assert sorted(int(n.split("_")[0][2:]) for n in catalog.QUERIES) == list(range(1, 14))
