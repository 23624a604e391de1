"""Bounded samples of labelled documents, and models that one task fits on them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.session import ship_package


def held_out(id_col: str) -> Column:
    """Rows that no model learns from: the CRC-32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def label_sample(labels: DataFrame, label_col: str, rows: int, by_label: bool = False, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled ids in order of their hash (of each label 0 and 1 with ``by_label``).

    Held-out rows and null labels are left out; an id with several labels counts with the least.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    by_hash = lambda df: df.orderBy(F.xxhash64("id"), "id").limit(rows)
    return by_hash(known.where("label = 0")).unionByName(by_hash(known.where("label = 1"))) if by_label else by_hash(known)


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], object]):
    """What ``fit`` makes of the rows of a bounded sample, in one task (None of no rows); ``fit`` must order them itself.

    The rows are shuffled to that task, so the scans before it stay with all tasks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [f for f in frames if len(f)]
        model = fit(pd.concat(whole, ignore_index=True)) if whole else None
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    ship_package(sample.sparkSession)
    row = sample.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(row["model"]) if row else None


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by Newton steps on smoothed labels."""
    up, down = weight[label == 1].sum(), weight[label == 0].sum()
    want = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(50):
        p = sigmoid(a * score + b)
        g, h = weight * (p - want), weight * p * (1 - p) + 1e-9
        m = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, np.array([(g * score).sum() + 1e-3 * a, g.sum()]))
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)
