"""Whitened embeddings on exact integer levels.

An entry c becomes the integer floor(SCALE * c) + OFFSET.  Distinct level vectors are
packed into the fewest bytes and form the fit list; their sums and, centred on the
rounded mean, their scatter are exact integers, summed in tasks as long values per digit
of ``DIGIT`` bits and merged as decimals.  Eigenvalues and components come from the exact
characteristic polynomial of the scatter (``spectrum``).  What leaves the tasks for the
driver is bounded by the square of the dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsift.llm.shared import saved
from gridsift.llm.spectrum import leading
from gridsift.llm.vectors import matrix, usable, whole
from gridsift.llm.words import text_buffers

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Levels without the offset are held to this on either side.
LIMIT = 1 << 60
WIDTHS = (1, 2, 4, 8)
DIGIT = 20
#: So many rows of digits can be multiplied in doubles without rounding (2 * DIGIT + 13 bits).
EXACT_ROWS = 1 << 13
FLUSH_ROWS = 1 << 20
SUMS = "i int, j int, digit int, value long"


def _packed(size: int) -> Callable:
    """Vectors to their levels without offset, in the fewest bytes that hold a whole vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = whole(matrix(batch.column(0), size), SCALE, LIMIT)
            top = np.maximum(levels, -1 - levels).max(axis=1, initial=0)
            place = np.searchsorted([1 << (8 * w - 1) for w in WIDTHS[:-1]], top, "right")
            for k, width in enumerate(WIDTHS):
                rows = levels[place == k].astype(f"<i{width}")
                if len(rows):
                    places = np.arange(len(rows) + 1, dtype=np.int32) * (size * width)
                    yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(places), pa.py_buffer(rows.tobytes())])], ["x"])

    return run


def _unpacked(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The level vectors of a packed column, in any order."""
    data, places = text_buffers(column)
    lengths = np.diff(places)
    for width in WIDTHS:
        at = places[:-1][lengths == size * width]
        if len(at):
            raw = data[at[:, None] + np.arange(size * width)]
            yield np.ascontiguousarray(raw).view(f"<i{width}").astype(np.int64)


def _sums(size: int) -> Callable:
    """Packed vectors to sums of each dimension (j = -1), in digits, and their number (i = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, n = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
            for levels in _unpacked(batch.column(0), size):
                low += (levels & ((1 << DIGIT) - 1)).sum(axis=0)
                high += (levels >> DIGIT).sum(axis=0)
                n += len(levels)
            each = np.arange(size)
            yield _rows(np.concatenate([each, each, [-1]]), np.full(2 * size + 1, -1), np.repeat([0, 1, 0], [size, size, 1]), np.concatenate([low, high, [n]]))

    return run


def _rows(i, j, digit, value) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((i, j, digit, value), kinds, strict=True)], ["i", "j", "digit", "value"])


def digits(values: np.ndarray) -> list[np.ndarray]:
    """Integers as digits of ``DIGIT`` bits in doubles; the last one carries the sign."""
    out = []
    while values.size and max(int(values.max()), -1 - int(values.min())) >= 1 << DIGIT:
        out.append((values & ((1 << DIGIT) - 1)).astype(np.float64))
        values = values >> DIGIT
    return [*out, values.astype(np.float64)]


def _scatter(size: int, pivot: list[int]) -> Callable:
    """Packed vectors to the sums of products of their distances from ``pivot``, and of the distances (j = -1)."""
    i, j = np.triu_indices(size)
    centre = np.array(pivot, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray] = {}
        rows = 0

        def flush():
            for d, total in sorted(products.items()):
                yield _rows(i, j, np.full(len(i), d), total[i, j])
            for d, total in sorted(sums.items()):
                yield _rows(np.arange(size), np.full(size, -1), np.full(size, d), total)
            products.clear()
            sums.clear()

        for batch in batches:
            for levels in _unpacked(batch.column(0), size):
                for at in range(0, len(levels), EXACT_ROWS):
                    parts = digits(levels[at : at + EXACT_ROWS] - centre)
                    for a, left in enumerate(parts):
                        sums[a] = sums.get(a, 0) + left.sum(axis=0).astype(np.int64)
                        for b, right in enumerate(parts):
                            products[a + b] = products.get(a + b, 0) + (left.T @ right).astype(np.int64)
                rows += len(levels)
                if rows >= FLUSH_ROWS:
                    yield from flush()
                    rows = 0
        yield from flush()

    return run


def _added(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Exact totals by place (i, j), of which there are at most the square of the dimension."""
    totals = rows.groupBy("i", "j", "digit").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    out: dict[tuple[int, int], int] = {}
    for r in totals.collect():
        out[r["i"], r["j"]] = out.get((r["i"], r["j"]), 0) + (int(r["value"]) << (DIGIT * r["digit"]))
    return out


def _whitened(levels: np.ndarray, centre: np.ndarray, rest: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Distances from the mean, which is ``centre + rest``, along the weighted components."""
    return ((levels - centre).astype(np.float64) - rest) @ weights


def _moments(size: int, centre: np.ndarray, rest: np.ndarray, weights: np.ndarray) -> Callable:
    """Packed vectors to sums of their whitened values (j = -1) and of the products of these."""
    k = weights.shape[1]
    i, j = np.divmod(np.arange(k * k), max(k, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for levels in _unpacked(batch.column(0), size):
                w = _whitened(levels, centre, rest, weights)
                first += w.sum(axis=0)
                second += w.T @ w
        columns = [np.concatenate([np.arange(k), i]), np.concatenate([np.full(k, -1), j])]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(np.concatenate([first, second.reshape(-1)]))], ["i", "j", "value"])

    return run


class Whitening:
    """What is fitted: number of vectors, mean (``centre + rest``), eigenvalues and components."""

    def __init__(self, size: int, n: int, sums: list[int], values: list[Fraction], vectors: np.ndarray, trace: int):
        self.size, self.n, self.sums = size, n, sums
        pivot = [_near(s, n) for s in sums]
        self.centre = np.array(pivot, np.int64)
        self.rest = np.array([float(Fraction(s - n * p, n)) for s, p in zip(sums, pivot, strict=True)])
        # The scatter is n * n times the covariance.
        self.eigenvalues = [float(v / n**2) for v in values]
        self.components = vectors
        self.explained = [float(v / trace) for v in values]
        self.weights = vectors.T / np.sqrt(np.array(self.eigenvalues))
        self.identity_error = 0.0


def _near(total: int, n: int) -> int:
    """total / n to the nearest integer."""
    return (2 * total + n) // (2 * n)


def fit(fit_list: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a packed fit list (column ``x``), or None of an empty one."""
    totals = _added(fit_list.mapInArrow(_sums(size), SUMS))
    n = totals.get((-1, -1), 0)
    if not n:
        return None
    sums = [totals[i, -1] for i in range(size)]
    pivot = [_near(s, n) for s in sums]
    found = _added(fit_list.mapInArrow(_scatter(size, pivot), SUMS))
    # n * (x - pivot) - rest is the centred vector times n, so this is its scatter over n, exactly.
    rest = [found[i, -1] for i in range(size)]
    scatter = [[n * found[min(i, j), max(i, j)] - rest[i] * rest[j] for j in range(size)] for i in range(size)]
    values, vectors = leading(scatter, components)
    out = Whitening(size, n, sums, values, vectors, sum(scatter[i][i] for i in range(size)))
    k = len(values)
    if k:
        moments = fit_list.mapInArrow(_moments(size, out.centre, out.rest, out.weights), "i int, j int, value double")
        sums_of = {(r["i"], r["j"]): r["value"] for r in moments.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
        mean = [sums_of[i, -1] / n for i in range(k)]
        out.identity_error = max(abs(sums_of[i, j] / n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(k))
    return out


def deviations(levels: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """Exact squared lengths of n * level - sums; None where they have over 38 digits."""
    if not levels.size:
        return []
    far = max(n * max(abs(int(levels.max())), abs(int(levels.min()))) + max(map(abs, sums)), 1)
    if far * far * levels.shape[1] < 1 << 63:
        distance = levels * n - np.array(sums, np.int64)
        return [Decimal(x) for x in (distance * distance).sum(axis=1).tolist()]
    distance = levels.astype(object) * n - np.array(sums, object)
    return [Decimal(x) if x < 10**38 else None for x in (distance * distance).sum(axis=1).tolist()]


def _applied(w: Whitening) -> Callable:
    """(id, vector) to a row for each component."""
    k = len(w.explained)
    # Distances are the same from levels and sums that both leave the offset out and both leave the centre out.
    rest = [s - w.n * c for s, c in zip(w.sums, w.centre.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = whole(matrix(batch.column(1), w.size), SCALE, LIMIT)
            values, n = _whitened(levels, w.centre, w.rest, w.weights), len(levels)
            far = pa.array(deviations(levels - w.centre, w.n, rest), pa.decimal128(38, 0))
            row = pa.array(np.repeat(np.arange(n), k))
            columns = [
                batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, w.n)), far.take(row),
                pa.array(values.reshape(-1)), pa.array(np.tile(w.explained, n)), pa.array(np.full(n * k, w.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows without a usable vector (see ``vectors.usable``: null or empty vectors, null or
    non-finite entries, other than the most frequent length) are left out; an empty table
    gives no rows.  The covariance is that of the distinct level vectors, of which there
    are ``n``; repeated rows and rows that share an id are each returned.  Components are
    numbered by falling eigenvalue; those without variance do not exist, so there are
    fewer than ``components`` where the vectors span less, and no rows if all are equal.
    Equal eigenvalues have orthonormal components of their common space.  ``deviation``
    is exact, a decimal(38,0), null beyond 38 digits; entries whose floor is beyond
    2 ** 60 on either side count as that.  Ids keep their type, null ones too, and other
    columns are not read.  The driver works on a square matrix of the dimension, which may
    be some hundreds.
    """
    slim, size = usable(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")))
    kind = slim.schema["id"].dataType.simpleString()
    kinds = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    whitening = None
    if size:
        fit_list = saved(slim.select("vector").mapInArrow(_packed(size), "x binary").distinct(), "levels")
        whitening = fit(fit_list, size, components)
    if whitening is None or not whitening.explained:
        return slim.sparkSession.createDataFrame([], kinds).withColumnRenamed("id", id_col)
    return slim.select("id", "vector").mapInArrow(_applied(whitening), kinds).withColumnRenamed("id", id_col)
