"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, everything but letters becomes a space, and runs of spaces
one.  For each language the model of order ``ORDER`` interpolates discounted counts
with continuation counts of the lower orders, down to a uniform share.  The n-grams
of all languages stand in one sorted array of hashes per order, with the probability
of each in every language; a second array per order holds the back-off weights of
contexts.  A text goes to the language of the lowest cross-entropy per character.
The score is the calibrated share of that language, and scores below a calibrated
limit are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsift.llm.labelled import fitted, held_out
from gridsift.llm.words import mix, small_slices, text_buffers
from gridsift.session import ship_package

ORDER = 4
#: Documents of each language that the models are fitted on, at most, and those for calibration.
SAMPLE, CALIBRATION = 700, 300
DISCOUNT = 0.75
EVIDENCE = 100
ACCEPTED_RIGHT = 0.99
_P = np.uint64(0x9E3779B97F4A7C15)

_TABLES: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, its small letter, or a space if it is no letter."""
    if not _TABLES:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLES.append(table)
    return _TABLES[0]


def prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each with ``ORDER - 1`` spaces in front; where each begins; and its letters."""
    data, offsets = text_buffers(texts)
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    plain = letters()[chars]
    space = plain == 32
    count = np.diff(np.concatenate([[0], np.cumsum(~space)])[upto])
    # The first space of a run stays, unless the text begins with it.
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    heads = upto[:-1][np.diff(upto) > 0]
    keep[heads[space[heads]]] = False
    edges = np.concatenate([[0], np.cumsum(keep)])[upto]
    pad = ORDER - 1
    out = np.insert(plain[keep], np.repeat(edges[:-1], pad), 32).astype(np.uint32)
    return out, edges + pad * np.arange(len(edges)), count


def hashes(columns: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    h = np.zeros(len(columns), np.uint64)
    for c in columns.T:
        h = h * _P + c.astype(np.uint64) + np.uint64(1)
    return mix(h)


def grams_at(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` code points that end at each place."""
    h = np.zeros(len(at), np.uint64)
    for k in range(n - 1, -1, -1):
        h = h * _P + chars[at - k].astype(np.uint64) + np.uint64(1)
    return mix(h)


def events(edges: np.ndarray) -> np.ndarray:
    """Places of the characters behind the spaces in front of each text."""
    flags = np.zeros(int(edges[-1]) + 1, bool)
    flags[: int(edges[-1])] = True
    for k in range(ORDER - 1):
        flags[edges[:-1] + k] = False
    return np.flatnonzero(flags[: int(edges[-1])])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to counts of ``ORDER``-grams as arrays of code points."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        for lang in sorted(set(names)):
            own = batch.filter(pa.array([x == lang for x in names]))
            for part in small_slices(own, 1):
                chars, edges, _ = prepared(part.column(1))
                at = events(edges)
                if not len(at):
                    continue
                _, first, n = np.unique(grams_at(chars, at, ORDER), return_index=True, return_counts=True)
                rows = np.stack([chars[at[first] - k] for k in range(ORDER - 1, -1, -1)], axis=1).astype(np.int32)
                places = pa.array(np.arange(0, rows.size + 1, ORDER, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.ListArray.from_arrays(places, pa.array(rows.reshape(-1))), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted hash in a sorted array, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _language_tables(grams: np.ndarray, counts: np.ndarray) -> list[dict]:
    """For each order from 1: n-grams with their (continuation) counts, and contexts with their totals and kinds."""
    levels = []
    for n in range(ORDER, 0, -1):
        keys = hashes(grams)
        order = np.argsort(keys)
        context_keys = hashes(grams[:, :-1])
        contexts, first, back = np.unique(context_keys, return_index=True, return_inverse=True)
        levels.append({
            "grams": grams[order], "keys": keys[order], "counts": counts[order], "contexts": contexts, "context_rows": grams[first, :-1],
            "total": np.bincount(back, weights=counts), "kinds": np.bincount(back),
        })
        if n > 1:
            # The count of a shorter n-gram is the number of characters seen in front of it.
            shorter, first, counts = np.unique(hashes(grams[:, 1:]), return_index=True, return_counts=True)
            grams, counts = grams[first, 1:], counts.astype(float)
    return levels[::-1]


def _probabilities(tables: list[dict], grams: np.ndarray, uniform: float) -> np.ndarray:
    """Interpolated probability of the last character of each n-gram given the others."""
    p = np.full(len(grams), uniform)
    width = grams.shape[1]
    for n in range(1, width + 1):
        t, own = tables[n - 1], grams[:, width - n :]
        at, seen = _find(t["contexts"], hashes(own[:, :-1]))
        total, kinds = t["total"][at], t["kinds"][at]
        place, there = _find(t["keys"], hashes(own))
        count = np.where(there, t["counts"][place], 0.0)
        p = np.where(seen, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.where(seen, total, 1), p)
    return p


def fit_models(rows: pd.DataFrame) -> dict | None:
    """The joint tables of all languages from (lang, gram, n)."""
    names = sorted(rows["lang"].unique())
    if not names:
        return None
    tables, alphabet = [], set()
    for lang in names:
        own = rows[rows["lang"] == lang]
        grams, counts = np.stack(own["gram"]).astype(np.uint32), own["n"].to_numpy(float)
        order = np.lexsort(grams.T[::-1])
        tables.append(_language_tables(grams[order], counts[order]))
        alphabet |= set(np.unique(grams).tolist())
    uniform = 1 / (len(alphabet) + 1)
    model = {"names": names, "orders": [], "uniform": np.float32(np.log(uniform))}
    for n in range(1, ORDER + 1):
        grams = np.concatenate([t[n - 1]["grams"] for t in tables])
        keys, first = np.unique(hashes(grams), return_index=True)
        grams = grams[first]
        logs = np.stack([np.log(_probabilities(t, grams, uniform)) for t in tables], axis=1).astype(np.float32)
        contexts, first = np.unique(np.concatenate([t[n - 1]["contexts"] for t in tables]), return_index=True)
        weight = np.zeros((len(contexts), len(names)), np.float32)
        for k, t in enumerate(tables):
            at, seen = _find(t[n - 1]["contexts"], contexts)
            weight[:, k] = np.where(seen, np.log(DISCOUNT * t[n - 1]["kinds"][at] / t[n - 1]["total"][at]), 0)
        model["orders"].append({"keys": keys, "logs": logs, "contexts": contexts, "weights": weight})
    return model


def log_probabilities(model: dict, chars: np.ndarray, at: np.ndarray, n: int = ORDER) -> np.ndarray:
    """Log probability in each language of the characters at the places, given ``n - 1`` before."""
    if n == 0:
        return np.full((len(at), len(model["names"])), model["uniform"], np.float32)
    order = model["orders"][n - 1]
    place, there = _find(order["keys"], grams_at(chars, at, n))
    out = order["logs"][place]
    if (new := np.flatnonzero(~there)).size:
        low = log_probabilities(model, chars, at[new], n - 1)
        # An unseen n-gram has the back-off weight of its context times the shorter one's probability.
        context, seen = _find(order["contexts"], grams_at(chars, at[new] - 1, n - 1) if n > 1 else hashes(np.zeros((len(new), 0), np.uint32)))
        out[new] = low + np.where(seen[:, None], order["weights"][context], 0)
    return out


def cross_entropies(model: dict, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Nats per character of each text in each language, and the number of its letters."""
    chars, edges, letters_in = prepared(texts)
    at = events(edges)
    logs = log_probabilities(model, chars, at)
    sizes = np.diff(edges) - (ORDER - 1)
    first = np.concatenate([[0], np.cumsum(sizes)])
    total = np.zeros((len(texts), len(model["names"])))
    filled = np.flatnonzero(sizes > 0)
    if len(filled):
        total[filled] = np.add.reduceat(logs, first[filled], axis=0, dtype=np.float64)
    return -total / np.maximum(sizes, 1)[:, None], letters_in


def shares(entropy: np.ndarray, n: np.ndarray, heat: float) -> np.ndarray:
    """Share of each language, from entropies per character and at most ``EVIDENCE`` characters."""
    x = -(entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(n, EVIDENCE)[:, None] * heat
    e = np.exp(np.maximum(x, -700))
    return e / e.sum(axis=1, keepdims=True)


def calibrate(model: dict, rows: pd.DataFrame) -> tuple[float, float]:
    """Heat of the shares of highest likelihood on (id, lang, text), and the least accepted score.

    That score is the lowest at which accepted rows are right at the wanted rate.
    """
    rows = rows[rows["lang"].isin(model["names"])].sort_values("id", kind="stable")
    if not len(rows):
        return 0.1, 0.0
    entropy, n = cross_entropies(model, pa.array(rows["text"], pa.string()))
    some = n > 0
    entropy, n = entropy[some], n[some]
    want = np.array([model["names"].index(x) for x in rows["lang"][some]], int)
    if not len(want):
        return 0.1, 0.0
    heats = 10 ** np.linspace(-3, 0.5, 36)
    loss = [-np.log(np.maximum(0.999 * shares(entropy, n, t)[np.arange(len(want)), want] + 0.001 / len(model["names"]), 1e-12)).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    share = shares(entropy, n, heat)
    score, right = share.max(axis=1), share.argmax(axis=1) == want
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= ACCEPTED_RIGHT
    return heat, float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0


def _least(most: int):
    """(id, lang, key) frames to the ``most`` rows of least key of each language, of all rows of the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            both = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            kept = both.sort_values(["key", "id"], kind="stable").groupby("lang", sort=False).head(most)
        if kept is not None:
            yield kept

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict | None:
    """The models of at most ``sample`` documents of each language, in order of the hash of their ids.

    Held-out rows, null languages and null texts are left out; None if nothing is left.
    The n-grams of the sample are counted by Spark and fitted in one task.
    """
    ship_package(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"))
    # Each task keeps the least hashes of its own rows, groups of tasks those of theirs, and then all.
    most = sample + CALIBRATION
    keyed = known.select("id", "lang", F.xxhash64("id").alias("key"))
    kept = keyed.mapInPandas(_least(most), keyed.schema).withColumn("tasks", F.pmod(F.spark_partition_id(), F.lit(64)))
    at = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("key", "id"))
    first = kept.withColumn("at", at("lang", "tasks")).where(F.col("at") <= most)
    ranked = first.withColumn("at", at("lang")).where(F.col("at") <= most)
    chosen = ranked.select("id", (F.col("at") > sample).alias("checks")).collect()
    if not chosen:
        return None
    frame = docs.sparkSession.createDataFrame(chosen, "id long, checks boolean")
    texts = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    texts = texts.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(frame), "id").persist()
    try:
        counts = rows.where("NOT checks").select("lang", "text").mapInArrow(_counts, "lang string, gram array<int>, n long")
        model = fitted(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), fit_models)
        if model is not None:
            heat, least = fitted(rows.where("checks").select("id", "lang", "text"), lambda r: calibrate(model, r)) or (0.1, 0.0)
            model |= {"heat": heat, "least": least}
    finally:
        rows.unpersist()
    return model


def _predicted(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, 1):
                n = part.num_rows
                lang, score, rejected = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
                if model is not None:
                    entropy, count = cross_entropies(model, part.column(1))
                    some = np.flatnonzero(count > 0)
                    share = shares(entropy[some], count[some], model["heat"])
                    lang[some] = np.array(model["names"], object)[entropy[some].argmin(axis=1)]
                    score[some] = share.max(axis=1)
                    rejected[some] = score[some] < model["least"]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    return run


def languages(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, rejected.

    ``lang_pred`` is ``und`` with score 0 for a null text, a text without a letter, or
    where nothing was learned; other texts get the language of the lowest entropy
    per character (of equal ones the first by name), rejected or not.  A null id is not held out.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = slim.mapInArrow(_predicted(model), "id long, lang_pred string, score double, rejected boolean")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "rejected")
