"""Hard negatives of anchor vectors, from exact integer scores.

Scores are inner products of integer components, taken in blocks of rows against blocks
of anchors.  Both matrices are reduced modulo several small primes; the products of the
residues are single precision matrix products whose sums stay below 2**24, so they are
exact, and Chinese remaindering (mixed radix digits) gives the signed score.

Two sweeps over the blocks: the first finds the best rows of an anchor's own label, its
positives; the second finds, for each positive, the best rows of other labels in the
window below its score.  A block pair leaves at most ``k`` rows for an anchor (and
positive), ranked again over all blocks.  Anchors are a stated query set, held against all
rows; a block is some hundred kilobytes, and every task streams its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsift.llm.shared import saved
from gridsift.llm.spectrum import primes_below
from gridsift.llm.vectors import matrix, usable, whole

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least ``FLOOR[0] / FLOOR[1]`` of the positive, and at most as much.
FLOOR = (80, 100)
ROWS, ANCHORS = 4096, 512
ANCHOR_STEP = 100
EXACT = 1 << 24
LOWEST = np.iinfo(np.int64).min


def limit_of(size: int) -> int:
    """Components are held to this, so that no score leaves 63 bits."""
    return int((1 << 62) ** 0.5 / max(size, 1) ** 0.5) - 1


def moduli(size: int, bound: int) -> list[int]:
    """Primes for vectors of ``size`` components and scores up to ``bound`` on either side.

    Residues between -p/2 and p/2 have ``size`` products that add up to less than 2**24.
    """
    top = max(int((4 * (EXACT - 1) / max(size, 1)) ** 0.5), 3)
    out, product = [], 1
    for p in primes_below(min(top, 1 << 12) + 1):
        out.append(p)
        product *= p
        if product > 2 * bound + 1:
            return out
    raise ValueError("vectors are too long for single precision residues")


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Residues nearest to 0, in single precision."""
    r = values % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, with components up to ``limit_of``."""
    size = left.shape[1]
    far = [int(np.abs(x).max(initial=0)) for x in (left, right)]
    bound = size * far[0] * far[1]
    primes = moduli(size, bound)
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        product = residues(left, p) @ residues(right, p).T
        # The score plus the bound is not negative; its residue, then its next mixed radix digit.
        digit = (product.astype(np.int64) + bound % p) % p
        for q, d in zip(primes[:k], digits, strict=True):
            digit = (digit - d) * pow(q, -1, p) % p
        digits.append(digit)
    total = np.zeros(digits[0].shape, np.uint64)
    for p, d in zip(primes[::-1], digits[::-1], strict=True):
        total = total * np.uint64(p) + d.astype(np.uint64)
    return (total - np.uint64(bound)).view(np.int64)


def best(order: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the up to ``k`` allowed places of highest order, as (row, place) pairs.

    No two places of a row have the same order.
    """
    held = np.where(allowed, order, LOWEST)
    k = min(k, held.shape[1])
    if k < held.shape[1]:
        place = np.argpartition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k :]
    else:
        place = np.broadcast_to(np.arange(k), held.shape)
    row = np.repeat(np.arange(len(held)), k)
    place = place.reshape(-1)
    good = held[row, place] > LOWEST
    return row[good], place[good]


def orders(found: np.ndarray) -> np.ndarray:
    """Numbers that put the higher score first and, of equal ones, the earlier place; all differ in a row."""
    n = found.shape[1]
    if n and int(np.abs(found).max(initial=0)) < (1 << 62) // n:
        return found * n + np.arange(n - 1, -1, -1)
    rank = np.empty(found.shape, np.int64)
    np.put_along_axis(rank, np.argsort(~found, axis=1, kind="stable"), np.broadcast_to(np.arange(n), found.shape), axis=1)
    return -rank


# A block packs rows: their keys, ids, whether they have an id, labels, and components in the fewest bytes.
BLOCK = "keys array<bigint>, ids binary, known binary, labels binary, vectors binary"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]


def _blocks(size: int, most: int) -> Callable:
    """(key, id, label, vector) rows to blocks of at most ``most`` rows, by rising id, null last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                known = part.column(1).is_valid().to_numpy(zero_copy_only=False)
                key, ids, label = (part.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8") for c in range(3))
                place = np.lexsort((ids, ~known))
                vectors = whole(matrix(part.column(3), size), SCALE, limit_of(size))
                far = int(np.abs(vectors).max(initial=0))
                width = next(w for w in (1, 2, 4, 8) if far < 1 << (8 * w - 1))
                parts = (ids[place], known[place], label[place], vectors[place].astype(f"<i{width}"))
                yield pa.RecordBatch.from_arrays([pa.array([key[place]], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], NAMES)

    return run


class Block:
    def __init__(self, batch: pa.RecordBatch, row: int, at: int, size: int):
        self.keys = batch.column(at)[row].values.to_numpy(zero_copy_only=False)
        ids, known, labels, vectors = (batch.column(at + k)[row].as_buffer() for k in range(1, 5))
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.known = np.frombuffer(known, bool)
        width = vectors.size // (len(self.ids) * size)
        self.vectors = np.frombuffer(vectors, f"<i{width}").astype(np.int64).reshape(-1, size)

    def id_column(self, place: np.ndarray) -> pa.Array:
        return pa.array(self.ids[place], pa.int64(), mask=~self.known[place])


POSITIVE = "anchor long, anchor_id long, positive long, positive_id long, score long"


def _positives(size: int, k: int) -> Callable:
    """(anchor block, row block) to the best rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                anchors, rows = Block(batch, row, 0, size), Block(batch, row, 5, size)
                found = scores(anchors.vectors, rows.vectors)
                same = (anchors.labels[:, None] == rows.labels) & (anchors.keys[:, None] != rows.keys)
                a, r = best(orders(found), same, k)
                columns = [pa.array(anchors.keys[a]), anchors.id_column(a), pa.array(rows.keys[r]), rows.id_column(r), pa.array(found[a, r])]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "anchor_id", "positive", "positive_id", "score"])

    return run


NEGATIVE = "anchor long, place int, negative_id long, negative_score long"


def _negatives(size: int, k: int, floor: tuple[int, int]) -> Callable:
    """(anchor block, row block, positives of the block's anchors) to the best rows of other labels in each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                anchors, rows = Block(batch, row, 0, size), Block(batch, row, 5, size)
                tops = batch.column(10)[row].as_py()
                found = scores(anchors.vectors, rows.vectors)
                order, other = orders(found), anchors.labels[:, None] != rows.labels
                place_of = {key: n for n, key in enumerate(anchors.keys.tolist())}
                by_place: dict[int, list[tuple[int, int]]] = {}
                for top in tops:
                    by_place.setdefault(top["place"], []).append((place_of[top["anchor"]], top["score"]))
                for place, held in sorted(by_place.items()):
                    at, score = (np.array(x, np.int64) for x in zip(*held, strict=True))
                    # The least whole score of the window; exact, as the score is split by quotient and remainder.
                    least = score // floor[1] * floor[0] - (-(score % floor[1]) * floor[0] // floor[1])
                    here = found[at]
                    window = other[at] & (here <= score[:, None]) & (here >= least[:, None])
                    a, r = best(order[at], window, k)
                    columns = [pa.array(anchors.keys[at[a]]), pa.array(np.full(len(a), place), pa.int32()), rows.id_column(r), pa.array(here[a, r])]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "place", "negative_id", "negative_score"])

    return run


def _first(rows: DataFrame, keys: list[str], score: str, name: str, k: int, out: str, tie: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key by falling score, then rising id; Spark cuts the rows of each task before it deals them out."""
    order = [F.desc(score), F.asc_nulls_last(name), *([F.col(tie)] if tie else [])]
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)


def hard_negatives(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_step: int = ANCHOR_STEP,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    floor: tuple[int, int] = FLOOR,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) rows.

    Rows without a label or a usable vector (see ``vectors.usable``) take no part.  The
    rows whose id is divisible by ``anchor_step`` are anchors; their positives are the first
    ``positives`` other rows of their label by falling score, then rising id, and each
    positive's negatives are the first ``negatives`` rows of other labels that score at
    most as much as it and at least ``floor[0] / floor[1]`` of it (none if its score is
    negative).  A row without id is no anchor, but may be chosen; it comes last of
    equal scores.  Rows that share an id are rows of their own, as anchors too; of
    equal scores and ids any is taken, which the result does not show.  Components
    whose floor is beyond ``limit_of`` count as that limit, so scores fit 63 bits.  An
    empty table gives no rows; other columns are not read.  Ids and labels are integers.
    """
    slim, size = usable(rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")).where("label IS NOT NULL"))
    wanted = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size:
        return rows.sparkSession.createDataFrame([], wanted)
    # Saved, so that a row's key is the same in all that follows.
    keyed = saved(slim.select(F.monotonically_increasing_id().alias("key"), "id", "label", "vector"), "vectors")
    is_anchor = F.col("id") % anchor_step == 0
    n = keyed.agg(F.count_if(is_anchor).alias("anchors"), F.count(F.lit(1)).alias("rows")).first()
    parts = -(-n["anchors"] // ANCHORS)
    if not parts:
        return rows.sparkSession.createDataFrame([], wanted)
    groups = -(-n["rows"] // ROWS)
    anchors = keyed.where(is_anchor).repartition(parts).mapInArrow(_blocks(size, ANCHORS), BLOCK)
    anchors = saved(anchors.withColumn("block", F.monotonically_increasing_id()), "anchors")
    # Row blocks are dealt evenly to groups, and each group gets a copy of every anchor block.
    blocks = keyed.mapInArrow(_blocks(size, ROWS), BLOCK).repartition(groups)
    dealt = saved(blocks.withColumn("group", F.spark_partition_id()), "blocks")
    each_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))

    def pairs(left: DataFrame, *more: str) -> DataFrame:
        right = dealt.select("group", *[F.col(c).alias(f"row_{c}") for c in NAMES])
        joined = left.withColumn("group", each_group).hint("shuffle_merge").join(right, "group")
        return joined.select(*NAMES, *[f"row_{c}" for c in NAMES], *more)

    found = pairs(anchors).mapInArrow(_positives(size, positives), POSITIVE)
    tops = saved(_first(found, ["anchor"], "score", "positive_id", positives, "place", "positive"), "positives")
    # The windows of a block's anchors go with the block: at most ``positives`` for each of its anchors.
    member = anchors.select("block", F.explode("keys").alias("anchor"))
    windows = tops.join(member, "anchor").groupBy("block").agg(F.collect_list(F.struct("anchor", F.col("place").cast("int").alias("place"), "score")).alias("tops"))
    windowed = saved(anchors.join(windows, "block"), "windows")
    found = pairs(windowed, "tops").mapInArrow(_negatives(size, negatives, floor), NEGATIVE)
    chosen = _first(found, ["anchor", "place"], "negative_score", "negative_id", negatives, "rank")
    named = tops.select("anchor", F.col("place").cast("int").alias("place"), "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return chosen.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
