"""The registered queries: a Spark form and, where SQL can say it, an SQL form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        label = name or run.__name__
        if label in REGISTRY:
            raise ValueError(f"query registered twice: {label}")
        REGISTRY[label] = Query(label, run, sql)
        return run

    return add


def load_all() -> dict[str, Query]:
    from gridsift.catalog import delivering, ledgering, scalars, scoring, shaping, streams  # noqa: F401

    return REGISTRY
