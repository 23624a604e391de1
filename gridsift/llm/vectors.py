"""Vector columns: which rows can be used, and matrices of whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.session import ship_package


def finite(vector: Column) -> Column:
    """Whether a vector has entries, none of them null, NaN or infinite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows of ``rows`` with a usable column ``vector`` (as doubles), and the length of their vectors.

    Vectors that are null or empty, or hold null or non-finite entries, are left out, and
    so are those of other than the most frequent length (the greatest of several).  The
    length is 0 if no row is left.
    """
    ship_package(rows.sparkSession)
    good = rows.withColumn("vector", F.col("vector").cast("array<double>")).where(finite(F.col("vector")))
    length = F.size("vector").alias("length")
    lengths = good.groupBy(length).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    size = most["length"] if most else 0
    return good.where(F.size("vector") == size), size


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as the rows of a matrix of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def whole(values: np.ndarray, factor: int, limit: int) -> np.ndarray:
    """floor(factor * value) as 64-bit integers, held to ``limit`` on either side."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * factor), -float(limit), float(limit)).astype(np.int64)
