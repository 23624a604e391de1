"""Near duplicates by fast similarity sketches, banding and exact verification.

Sketch of a set, of ``t`` coordinates: in round i = 0 .. t-1 every element throws a
ball of value (i, hash) into a hashed bin, and a bin keeps the least; a text leaves
the rounds when all its bins are filled.  In rounds t .. 2t-1 every element throws
into bin i - t, so each coordinate is filled whatever the size of the set, and the
share of equal coordinates is concentrated around the similarity.  Sets of n
elements take about n + t log t throws, not n times t.

Texts with equal sets form a class, found by merged digest runs, and only one row
of each class goes on.  Bands of ``rows`` coordinates give bucket keys.  Two sets
at the threshold share no bucket with probability (1 - s ** rows) ** bands, below
1e-5 with the settings here.  No bucket is expanded into pairs: its members are compared
with one centre, the member with the most bucket mates.  Where members of a bucket
remain in different components, they are compared across components if they share
one of their rarest shingles, as sets of this similarity must.  All links are
confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsift.llm.exact_dedup import RUNS, merge_runs
from gridsift.llm.graph import components
from gridsift.llm.shared import saved
from gridsift.llm.words import LOWER, SHINGLE, find_words, mix, seeded, small_slices, text_buffers, window_hashes
from gridsift.plans.joins import join_small
from gridsift.session import ship_package

ROWS, BANDS = 6, 60
NUMERATOR, DENOMINATOR = 75, 100
EMPTY = np.uint64((1 << 64) - 1)
#: Shingles of so many texts go to the end of the order, by their number; the others are ordered by hash alone.
FREQUENT = 4
#: Shingle hashes keep 64 bits less these.
DOC_BITS = 8


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text in sorted order, and the size of each set."""
    data, offsets = text_buffers(texts)
    words = find_words(LOWER[data], offsets)
    value, begins = window_hashes(words, words.hashes())
    doc = np.searchsorted(words.first, begins, "right") - 1
    sizes = np.zeros(len(texts), np.int64)
    out = []
    # Hashes are sorted together with the number of their text, so many texts at a time as the free bits can count.
    value >>= np.uint64(DOC_BITS)
    for base in range(0, len(texts), 1 << DOC_BITS):
        lo, hi = np.searchsorted(doc, [base, base + (1 << DOC_BITS)])
        tagged = np.sort(((doc[lo:hi] - base).astype(np.uint64) << np.uint64(64 - DOC_BITS)) | value[lo:hi])
        if len(tagged):
            tagged = tagged[np.concatenate([[True], tagged[1:] != tagged[:-1]])]
        owner = (tagged >> np.uint64(64 - DOC_BITS)).astype(np.int64)
        n = min(len(texts) - base, 1 << DOC_BITS)
        sizes[base : base + n] = np.bincount(owner, minlength=n)
        out.append(tagged & np.uint64((1 << (64 - DOC_BITS)) - 1))
    return np.concatenate(out or [value]), sizes


def sketches(value: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """The sketch of each set (rows), ``t`` coordinates each; an empty set keeps EMPTY throughout."""
    out = np.full((len(sizes), t), EMPTY)
    flat, wide = out.reshape(-1), np.uint64(t)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(t):
        if not len(value):
            return out
        h = seeded(value, i + 1)
        place = ((h >> np.uint64(32)) * wide) >> np.uint64(32)
        np.minimum.at(flat, owner * t + place.astype(np.int64), (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        if i % 4 == 1 or i == t - 1:
            here = np.unique(owner)
            full = np.zeros(len(sizes), bool)
            full[here] = (out[here] != EMPTY).all(axis=1)
            stay = ~full[owner]
            value, owner = value[stay], owner[stay]
    if len(value):
        here, begins = np.unique(owner, return_index=True)
        for b in range(t):
            least = np.minimum.reduceat(seeded(value, t + b + 1) & np.uint64(0xFFFFFFFF), begins)
            column = out[here, b]
            out[here, b] = np.where(column == EMPTY, (np.uint64(t + b) << np.uint64(32)) | least, column)
    return out


def band_keys(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def _profiles(rows: int, bands: int):
    """(id, text) batches to id, n_shingles, set digest and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, 1):
                value, sizes = shingle_sets(part.column(1))
                ends = np.cumsum(sizes)
                totals = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(seeded(value, 7001 + k))]) for k in range(3)]
                first, second, third = ((s[ends] - s[ends - sizes]) for s in totals)
                digest = np.stack([first, second], axis=1).astype("<u8").tobytes()
                keys = band_keys(sketches(value, sizes, rows * bands), rows, bands)
                keys = keys[sizes > 0].reshape(-1)
                at = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array([digest[k : k + 16] for k in range(0, len(digest), 16)], pa.binary()),
                        pa.array(third.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(keys)),
                    ],
                    ["id", "same_length", "digest", "same_hash", "bands"],
                )

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to (a, b, shared, total): sizes of intersection and union of full sets."""
    for batch in batches:
        for part in small_slices(batch, 2):
            n = part.num_rows
            value, sizes = shingle_sets(pa.concat_arrays([part.column(2), part.column(3)]))
            # Tag each hash with its pair; what occurs twice is shared.
            owner = np.repeat(np.tile(np.arange(n, dtype=np.uint64), 2), sizes)
            order = np.lexsort((value, owner))
            o, v = owner[order], value[order]
            twice = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
            shared = np.bincount(o[1:][twice].astype(np.int64), minlength=n)
            total = sizes[:n] + sizes[n:] - shared
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "shared", "total"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids with the sizes of intersection and union of their sets."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_overlaps, "a long, b long, shared long, total long")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, component) to a row for each distinct shingle."""
    for batch in batches:
        for part in small_slices(batch, 1, 1 << 20):
            value, sizes = shingle_sets(part.column(1))
            row = pa.array(np.repeat(np.arange(part.num_rows), sizes))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(row), part.column(2).take(row), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(value.view(np.int64))],
                ["id", "component", "n", "token"],
            )


def rare_pairs(texts: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, frequent: int = FREQUENT) -> DataFrame:
    """Pairs (a, b) of (id, text, component) in different components that can be similar enough.

    Exact: with all shingles in one order, two sets of at least the similarity share
    one of the first ``n - ceil(n * similarity) + 1`` shingles of either.  The order
    puts shingles of many texts last, so texts that share a common passage, and
    differ in over a quarter of the rest, never meet.  A pair meets at the first shingle
    it shares, and there only if what is left of both is long enough.
    """
    tokens = saved(texts.mapInArrow(_tokens, "id long, component long, n long, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") >= frequent)
    ordered = join_small(tokens, often, ["token"], "left").withColumn("often", F.coalesce("often", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "token"))
    first = F.expr(f"n - (n * {numerator} + {denominator - 1}) div {denominator} + 1")
    rows = saved(ordered.withColumn("place", place).where(F.col("place") <= first).select("id", "component", "n", "token", (F.col("n") - F.col("place")).alias("behind")), "prefixes")
    # Rows outside the largest component of a shingle meet all rows of it; rows of one component never do.
    kinds = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    top = kinds.groupBy("token").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    rows = saved(rows.join(top.select("token", F.col("top.component").alias("largest")), "token"), "prefixes")
    left = rows.where("component <> largest").select("token", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("behind").alias("ra"))
    right = rows.select("token", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("behind").alias("rb"))
    # Behind the first shingle two sets share, they share at most what is left of either.
    enough = f"{numerator + denominator} * (1 + least(ra, rb)) >= {numerator} * (na + nb)"
    close = F.expr(f"ca <> cb AND {denominator} * least(na, nb) >= {numerator} * greatest(na, nb) AND {enough}")
    return left.join(right, "token").where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = ROWS,
    bands: int = BANDS,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z.  A set holds the distinct five-word shingles, or
    the whole sequence of a shorter text; texts without words (or null) have an
    empty set and are linked with nothing.  Two documents are linked when
    ``denominator * intersection >= numerator * union``; ``component_id`` is the
    smallest id reachable.  Ids should be unique integers: rows that share an id
    count as one document, linked by what links any of them.  A row with a null id
    is linked with nothing: its component is null and it is kept.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = texts.mapInArrow(_profiles(rows, bands), "id long, same_length long, digest binary, same_hash long, bands array<long>")
    known = saved(known.select(
        "*", F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"), F.monotonically_increasing_id().alias("row"),
        F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id")).alias("best"),
    ), "sketches")
    classes = saved(merge_runs(known.drop("bands")).select("id", "row", F.col("same_length").alias("n_shingles"), F.col("winner.best.id").alias("rep"), F.col("winner.row").alias("rep_row")), "classes")

    single = known.where("same_length > 0 AND id IS NOT NULL").join(classes.where("row = rep_row").select("row"), "row")
    placed = single.select("id", F.explode("bands").alias("key"))
    sizes = saved(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    live = saved(placed.join(sizes, "key").select("id", "key", "n"), "bucketed")
    mates = live.groupBy("id").agg(F.sum("n").alias("mates"))
    live = saved(live.join(mates, "id").select("id", "key", "mates"), "bucketed")
    centre = live.groupBy("key").agg(F.min(F.struct((-F.col("mates")).alias("less"), F.col("id").alias("id"))).alias("c"))
    spokes = live.select("id", "key").join(centre.select("key", F.col("c.id").alias("centre")), "key").where("id <> centre")
    spokes = saved(spokes.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "pairs")
    same = F.expr(f"{denominator} * shared >= {numerator} * total")
    near = saved(join_small(texts, live.select("id").distinct(), ["id"], "left_semi"), "texts")
    # A document of several texts belongs to the classes of all of them.
    own = classes.where("n_shingles > 0 AND id IS NOT NULL").select("id", "rep")
    several = own.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("id")
    own = join_small(own, several, ["id"], "left_semi").where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b"))
    links = saved(verified(spokes, near).where(same).select("a", "b").unionByName(own).distinct(), "verified")
    found = saved(components(links), "components")

    # What a bucket still holds of different components is compared across them, through rare shingles.
    marked = live.select("id", "key").join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    marked = marked.withColumn("component", F.coalesce("component", "id"))
    mixed = marked.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rest = saved(marked.join(mixed, "key").select("id", "component").distinct(), "mixed")
    across = rare_pairs(near.join(rest, "id").select("id", "text", "component"), numerator, denominator)
    across = saved(across.join(spokes, ["a", "b"], "left_anti"), "pairs")
    more = saved(verified(across, near).where(same).select("a", "b").distinct(), "verified")
    if more.limit(1).count():
        found = saved(components(links.unionByName(more)), "components")

    named = found.where("node <> component").select(F.col("node").alias("rep"), "component")
    return classes.join(named, "rep", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when((F.col("n_shingles") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "rep")).alias("component_id"),
    ).select(id_col, "n_shingles", "component_id", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, with all columns."""
    flags = saved(near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col(id_col)).distinct(), "flags")
    return join_small(docs, flags, [id_col], "left_anti")
