import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridsift.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "gridsift-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_grid(spark):
    """Grid rows out of ``{table: [[cell, ...], ...]}``; '' is an empty cell."""
    from gridsift.operators.grid import as_grid

    def make(tables):
        rows = [
            (name, i, [None if c == "" else c for c in cells])
            for name, table in tables.items()
            for i, cells in enumerate(table)
        ]
        return as_grid(spark.createDataFrame(rows, "table_id string, row_idx bigint, cells array<string>"))

    return make
