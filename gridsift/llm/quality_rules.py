"""Quality rules: base counts, and a calibrated logistic regression on hashed n-grams.

Features are the shares of byte trigrams, words and word pairs, each hashed into a
part of one weight vector.  The regression is fitted on a bounded sample of labelled
rows in one task, and its scores are calibrated on rows of the sample it has not seen.
Scoring gathers weights for all n-grams of an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsift.llm.labelled import fitted, label_sample, platt, sigmoid
from gridsift.llm.measures import base_measures
from gridsift.llm.words import Words, mix, seeded, small_slices, text_buffers
from gridsift.session import ship_package

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 1000
BITS = 15
SIZE = 1 << BITS
STEPS = 80
LEAST_WORDS = 10
MOST_REPEATED = 20
#: A text is kept if label 1 has at least this probability.
THRESHOLD = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def n_grams(words: Words, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: weight numbers in order of text, and where each text begins."""
    data, offsets = words.data, words.offsets
    top = np.uint64(64 - BITS)
    wide = data.astype(np.uint64)
    three = mix(wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)) >> top if len(data) > 2 else np.zeros(0, np.uint64)
    # Trigrams must not cross into the next text.
    inside = np.arange(len(three)) + 3 <= np.repeat(offsets[1:], np.diff(offsets))[: len(three)]
    edges = np.concatenate([[0], np.cumsum(inside)])
    char = (three[inside].astype(np.int64), edges[np.minimum(offsets, len(three))])
    word = ((seeded(h, 11) >> top).astype(np.int64) + SIZE, words.first)
    n = len(h)
    follows = np.arange(n) + 2 <= np.repeat(words.first[1:], words.counts)
    pairs = np.flatnonzero(follows)
    pair_edges = np.concatenate([[0], np.cumsum(follows)])[words.first]
    pair = (seeded(seeded(h[pairs], 12) + h[pairs + 1] if n > 1 else np.zeros(0, np.uint64), 13) >> top).astype(np.int64) + 2 * SIZE
    return [char, word, (pair, pair_edges)]


def linear_scores(grams: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """Sum over the kinds of the mean weight of a text's n-grams."""
    score = 0.0
    for number, edges in grams:
        # In double precision: a text's score must not depend on the texts before it.
        upto = np.concatenate([[0.0], np.cumsum(weights[number], dtype=np.float64)])
        count = np.diff(edges)
        score = score + np.diff(upto[edges]) / np.maximum(count, 1)
    return score


def fit_regression(rows: pd.DataFrame, prior: tuple[int, int]) -> dict:
    """Weights and calibration from (id, label, text); ``prior`` has the counts of label 0 and 1 in all labels."""
    rows = rows.sort_values("id", kind="stable", ignore_index=True)
    n, entries = len(rows), []
    for start in range(0, n, 64):
        words, h, _ = base_measures(pa.array(rows["text"].iloc[start : start + 64], pa.string()))
        grams = n_grams(words, h)
        place = np.concatenate([np.repeat(np.arange(len(e) - 1), np.diff(e)) * (4 * SIZE) + x for x, e in grams])
        share = np.concatenate([np.repeat(1 / np.maximum(np.diff(e), 1), np.diff(e)) for _, e in grams])
        # One entry per text and n-gram.
        key, at = np.unique(place, return_inverse=True)
        entries.append((start + key // (4 * SIZE), key % (4 * SIZE), np.bincount(at, weights=share)))
    owner, number, value = (np.concatenate(x) for x in zip(*entries, strict=True))
    label = rows["label"].to_numpy()
    test = np.arange(n) % 4 == 3
    balance = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * n
    learn = np.where(test, 0.0, balance)
    weights, first, second = np.zeros(3 * SIZE), np.zeros(3 * SIZE), np.zeros(3 * SIZE)
    offset = 0.0
    for step in range(1, STEPS + 1):
        p = sigmoid(np.bincount(owner, weights=value * weights[number], minlength=n) + offset)
        error = learn * (p - label) / n
        slope = np.bincount(number, weights=value * error[owner], minlength=3 * SIZE) + 1e-7 * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        weights -= 0.5 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        offset -= 0.5 * error.sum()
    score = np.bincount(owner, weights=value * weights[number], minlength=n) + offset
    # Back from equal classes to the shares of all labels.
    real = np.where(label == 1, prior[1] / max(1, (label[test] == 1).sum()), prior[0] / max(1, (label[test] == 0).sum()))
    real = real * test.sum() / max(1, sum(prior))
    a, b = platt(score[test], label[test], real[test]) if test.any() else (1.0, 0.0)
    return {"weights": weights.astype(np.float32), "offset": offset, "a": a, "b": b}


def _scored(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, 1):
                words, h, found = base_measures(part.column(1))
                if model is None:
                    good = np.ones(part.num_rows)
                else:
                    good = sigmoid(model["a"] * (linear_scores(n_grams(words, h), model["weights"]) + model["offset"]) + model["b"])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[c], pa.int64()) for c in COUNTS), pa.array(good)], ["id", *COUNTS, "good"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict | None:
    """The model of at most ``sample`` labelled rows of each class; None if there is none."""
    chosen = label_sample(labels, label_col, sample, by_label=True, id_col=id_col)
    known = labels.where(F.col(label_col).isNotNull()).agg(F.count_if(F.col(label_col) == 0).alias("bad"), F.count_if(F.col(label_col) == 1).alias("good")).first()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")  # at most 2 * sample rows
    prior = (known["bad"], known["good"])
    return fitted(rows, lambda frame: fit_regression(frame, prior))


def quality(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, the five counts, base_failed, kept, good.

    ``good`` is the calibrated probability of label 1, from the text alone; without a
    model it is 1.  A null text has no words.  A text fails the base rules with fewer
    than 10 words, or if over 20 of 100 words lie in repeated windows of five words.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = slim.mapInArrow(_scored(model), "id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", good double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.select(F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"), (~failed & (F.col("good") >= threshold)).alias("kept"), "good")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever their names: each row is judged where it is read.

    Rows without id, and rows that share an id, are judged each by its own text.
    """
    ship_package(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, at):
                texts = part.column(at)
                words, h, found = base_measures(texts)
                n = found["n_words"]
                keep = (n >= LEAST_WORDS) & (100 * found["n_repeat_words"] <= MOST_REPEATED * n)
                if model is not None:
                    keep &= sigmoid(model["a"] * (linear_scores(n_grams(words, h), model["weights"]) + model["offset"]) + model["b"]) >= threshold
                yield part.filter(pa.array(keep))

    # Numbered names on the way: names may hold dots.
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)
