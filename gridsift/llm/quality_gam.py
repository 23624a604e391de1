"""Quality scores by a generalised additive model with pairwise interactions.

Features are counts and shares of the text.  Each is cut into bins, and boosting goes
round the features again and again: a shallow tree on one feature's bins, fitted to
what is left of the error, is added to that feature's lookup table.  Then the pairs
that explain most of the rest get two-way tables in the same way.  A score is the
sum of looked-up bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsift.llm.labelled import fitted, held_out, label_sample, sigmoid
from gridsift.llm.measures import (
    FIRST_BYTE, IS_DIGIT, IS_LETTER, IS_PUNCTUATION, IS_UPPER, base_measures, duplicate_lines, own_keys, per_text,
)
from gridsift.llm.shared import saved
from gridsift.llm.words import SPACE, small_slices
from gridsift.session import ship_package

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 40, 0.1, 2.0
THRESHOLD = 0.7
FEATURES = (
    "words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "foreign", "spaces",
    "line_length", "distinct", "short_words", "caps_words", "marked_words", "longest",
)


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text has zeros."""
    words, h, base = base_measures(texts)
    data, offsets = words.data, words.offsets
    n = words.counts
    one = np.maximum(n, 1)
    chars = np.maximum(per_text(FIRST_BYTE[data], offsets), 1)
    letters = np.maximum(per_text(IS_LETTER[data], offsets), 1)
    _, lines = duplicate_lines(data, offsets)
    doc = words.doc_of_word()
    _, first = np.unique(own_keys(h, doc), return_index=True)
    length = words.ends - words.starts
    head = data[words.starts] if len(h) else np.zeros(0, np.uint8)
    second = data[np.minimum(words.starts + 1, max(len(data) - 1, 0))] if len(h) else head
    last = data[words.ends - 1] if len(h) else head
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, doc, length)
    return np.stack([
        np.log1p(n), base["word_chars"] / one, base["n_symbols"] / chars, base["n_dup_lines"] / np.maximum(lines, 1), base["n_repeat_words"] / one,
        per_text(IS_UPPER[data], offsets) / letters, per_text(IS_DIGIT[data], offsets) / chars, per_text(IS_PUNCTUATION[data], offsets) / chars,
        per_text(data >= 128, offsets) / chars, per_text(SPACE[data], offsets) / chars, np.log1p(chars / np.maximum(lines, 1)),
        np.bincount(doc[first], minlength=len(n)) / one, per_text(length <= 3, words.first) / one,
        per_text(IS_UPPER[head] & IS_UPPER[second] & (length > 1), words.first) / one, per_text(IS_PUNCTUATION[last], words.first) / one,
        np.log1p(longest),
    ], axis=1).astype(np.float32)


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32))


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins (0: none)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Step of each bin by a tree of ordered cuts."""
    gain, cut = best_cut(g, h) if depth else (0.0, 0)
    if not gain:
        return np.full(len(g), RATE * g.sum() / (h.sum() + RIDGE))
    return np.concatenate([shallow_tree(g[:cut], h[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], depth - 1)])


def shallow_pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A cut on the first feature and then one on the second on either side, the best of all together."""

    def worth(rows: slice) -> float:
        own_g, own_h = g[rows].sum(axis=0), h[rows].sum(axis=0)
        return best_cut(own_g, own_h)[0] + own_g.sum() ** 2 / (own_h.sum() + RIDGE)

    cut = max(range(len(g)), key=lambda k: (worth(slice(0, k)) if k else 0.0) + worth(slice(k, len(g))))
    out = np.empty(g.shape)
    for rows in (slice(0, cut), slice(cut, len(g))):
        if g[rows].size:
            out[rows] = shallow_tree(g[rows].sum(axis=0), h[rows].sum(axis=0), 1)
    return out


def fit_model(rows: pd.DataFrame) -> dict:
    """The model of (id, label, features)."""
    rows = rows.sort_values("id", kind="stable", ignore_index=True)
    x, y = np.stack(rows["features"]).astype(np.float32), rows["label"].to_numpy().astype(float)
    edges = [edges_of(c, BINS) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    tables, total = [np.zeros(len(e) + 1) for e in edges], np.full(len(y), start)
    for _ in range(ROUNDS):
        for table, b in zip(tables, bins, strict=True):
            p = sigmoid(total)
            step = shallow_tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
            table += step
            total += step[b]
    coarse = [edges_of(c, PAIR_BINS) for c in x.T]
    small = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T, strict=True)]
    p = sigmoid(total)

    def grid(i, j, v):
        wide = len(coarse[j]) + 1
        return np.bincount(small[i] * wide + small[j], v, (len(coarse[i]) + 1) * wide).reshape(-1, wide)

    gains = {(i, j): float((grid(i, j, y - p) ** 2 / (grid(i, j, p * (1 - p)) + RIDGE)).sum()) for i in range(len(edges)) for j in range(i)}
    pairs = {k: np.zeros((len(coarse[k[0]]) + 1, len(coarse[k[1]]) + 1)) for k in sorted(gains, key=gains.get)[-PAIRS:]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in pairs.items():
            p = sigmoid(total)
            step = shallow_pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)))
            table += step
            total += step[small[i], small[j]]
    return {"start": start, "edges": edges, "tables": tables, "coarse": coarse, "pairs": pairs}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), model["start"])
    for e, table, c in zip(model["edges"], model["tables"], x.T, strict=True):
        total += table[np.searchsorted(e, c, "right")]
    for (i, j), table in model["pairs"].items():
        total += table[np.searchsorted(model["coarse"][i], x[:, i], "right"), np.searchsorted(model["coarse"][j], x[:, j], "right")]
    return sigmoid(total)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in small_slices(batch, 1):
            x = features(part.column(1))
            places = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(places, pa.array(x.reshape(-1)))], ["id", "features"])


def _scores(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = predict(model, x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    The text is read once: its features are kept, the model is fitted on those of at
    most ``sample`` labelled rows that are not held out, and all rows are scored.  A
    null text counts as empty and gets a score too; without labels every score is 0.5.
    A null id is not held out.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = saved(slim.mapInArrow(_features, "id long, features array<float>"), "features")
    rows = known.join(F.broadcast(label_sample(labels, label_col, sample, id_col=id_col)), "id")  # at most ``sample`` rows
    model = fitted(rows, fit_model)
    scored = known.mapInArrow(_scores(model), "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
