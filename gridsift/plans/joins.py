"""Joins of a large, possibly skewed side with a side that should be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridsift.session import materialize

BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 32


def _size():
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0)).alias("bytes")


def measured_bytes(df: DataFrame) -> int:
    """Text size of a frame, from one small aggregate."""
    return df.agg(_size()).first()["bytes"]


def kept_and_measured(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` computed once, and its text size, which the tasks take as they write it."""
    told = Observation()
    kept = materialize(df.observe(told, _size()))
    size = told.get.get("bytes")
    # A plan that is known to be empty loses its measure.
    return kept, measured_bytes(kept) if size is None else size


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join on key columns, with ``small`` on the right and unique per key.

    ``small`` is computed once and its size measured.  Below ``limit`` it is
    broadcast and ``big`` does not move.  Beyond it both sides are shuffled, with
    the keys of ``big`` salted by input partition and ``small`` repeated per salt,
    so that a key holding a third of ``big`` is spread over many tasks.
    """
    small, size = kept_and_measured(small)
    if size <= limit:
        return big.join(F.broadcast(small), list(on), how)
    salted = big.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Spark's own estimate, from the size of the files, may be far below what was measured: no broadcast after all.
    copies = copies.hint("merge")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
