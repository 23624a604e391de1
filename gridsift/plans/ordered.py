"""Window results over ordered groups of any size.

A plain window sends each group to one task.  Here the rows get a part number: their
place among cuts in group and order, which are taken from a sample of the keys.  A large
group lies in several consecutive parts; one exchange by part and group brings the rows
of each together, and summary rows of the groups at a cut carry the state across.

The order must be total within a group, up to rows that are equal throughout.  The keys
are read for the cuts and for the summary as well as with the rows, so a frame that is
costly, or that gives other rows when it is computed again, should be kept first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsift.session import materialize

PART = "_part"
SAMPLED_PER_PART = 50


def _place(keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.struct(*keys, *order)


def _cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row with the sorted places where parts begin: the quantiles of a sample, computed once."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.count()
    share = min(1.0, parts * SAMPLED_PER_PART / max(rows, 1))
    places = df.select(_place(keys, order).alias("at"))
    if share < 1:
        places = places.where(F.rand() < share)
    ranked = places.agg(F.sort_array(F.collect_list("at")).alias("all"))
    step = F.size("all") / F.lit(parts)
    wanted = F.transform(
        F.sequence(F.lit(1), F.lit(max(parts - 1, 1))), lambda i: F.get("all", F.floor(i * step).cast("int"))
    )
    return materialize(ranked.select(F.array_distinct(F.filter(wanted, lambda c: c.isNotNull())).alias("cuts")))


class _Parts:
    """The rows tagged with their part, and those of the groups that a cut may divide."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        cuts = _cuts(df, keys, order)
        most = cuts.select(F.size("cuts").alias("n")).first()["n"]
        place, held = _place(keys, order), df.withColumn("_cuts", cuts.scalar())
        # As many steps as the number of cuts has binary digits.
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))]).cast("array<int>")

        def halve(n: Column, step: Column) -> Column:
            passed = F.coalesce(F.get("_cuts", n + step - 1) <= place, F.lit(False))
            return F.when(passed, n + step).otherwise(n)

        def near(n: Column) -> Column:
            """Whether the group is that of a cut next to the part."""
            told = [(cut, [cut.getField(k).eqNullSafe(F.col(k)) for k in keys]) for cut in (F.get("_cuts", n - 1), F.get("_cuts", n))]
            return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, same, cut.isNotNull()) for cut, same in told])

        # The number of cuts up to the row, by halving, as one fold: a column for each step would be copied three
        # times into the next, and the plan would grow beyond the driver's memory.
        part = F.aggregate(steps, F.lit(0), halve)
        self.rows = held.withColumn(PART, part).drop("_cuts")
        # A group in several parts has a cut among its own rows, so it is that of a cut next to each of its parts.
        divided = held.where(F.aggregate(steps, F.lit(0), halve, near)) if keys else held
        self.divided = divided.withColumn(PART, part).drop("_cuts")

    def local(self):
        return Window.partitionBy(PART, *self.keys).orderBy(*self.order)

    def across(self):
        return Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(PART)

    def summary(self, *sums: Column) -> DataFrame:
        """One row per part and group, of the groups at a cut."""
        return self.divided.groupBy(PART, *self.keys).agg(*sums)

    def carry(self, rows: DataFrame, small: DataFrame, values: Sequence[str]) -> DataFrame:
        """Bring the carried values of a part and group to its rows, null where nothing is carried.

        Two groups at most lie at the cuts of a part: that is what makes ``small`` small
        enough to broadcast.
        """
        names = {key: f"_k{i}" for i, key in enumerate(self.keys)}
        right = small.select(F.col(PART).alias("_p"), *[F.col(key).alias(name) for key, name in names.items()], *values)
        match = F.col(PART) == F.col("_p")
        for key, name in names.items():
            match = match & F.col(key).eqNullSafe(F.col(name))
        return rows.join(F.broadcast(right), match, "left").drop("_p", *names.values())


def _earlier(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _number(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0))


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_number"
) -> DataFrame:
    """Add a dense 1-based row number per group (``keys`` may be empty)."""
    parts = _Parts(df, keys, order)
    before = F.sum("_rows").over(_earlier(parts.across()))
    summary = parts.summary(F.count(F.lit(1)).alias("_rows")).withColumn("_before", before)
    local = parts.rows.withColumn("_here", F.row_number().over(parts.local()))
    joined = parts.carry(local, summary, ["_before"])
    return joined.withColumn(out, F.coalesce("_before", F.lit(0)) + F.col("_here")).drop(PART, "_before", "_here")


def number_since(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], restart: str, out: str = "row_number"
) -> DataFrame:
    """Add the number of rows of the group after its last row with ``restart``, up to and with this one.

    Rows with ``restart`` (a boolean column without nulls) are not counted and get 0.
    """
    parts = _Parts(df, keys, order)
    counted, place = ~F.col(restart), F.struct(*order)
    last = parts.divided.where(restart).groupBy(PART, *keys).agg(F.max(place).alias("_last"))
    marked = parts.carry(parts.divided, last, ["_last"])
    fresh = F.col("_last").isNull() | (place > F.col("_last"))
    summary = marked.groupBy(PART, *keys).agg(
        _number(counted).alias("_rows"), _number(counted & fresh).alias("_tail"), F.max(F.col("_last").isNotNull()).alias("_restarts")
    )
    # What is open at the start of a part: all rows before it, less those up to the last restart.
    total = F.sum("_rows").over(parts.across().rowsBetween(Window.unboundedPreceding, 0))
    summary = summary.withColumn("_total", total)
    closed = F.max(F.when(F.col("_restarts"), F.col("_total") - F.col("_tail"))).over(_earlier(parts.across()))
    summary = summary.withColumn("_open", F.col("_total") - F.col("_rows") - F.coalesce(closed, F.lit(0)))
    so_far = parts.local().rowsBetween(Window.unboundedPreceding, 0)
    local = parts.rows.withColumn("_here", _number(counted).over(so_far))
    local = local.withColumn("_closed", F.max(F.when(F.col(restart), F.col("_here"))).over(so_far))
    joined = parts.carry(local, summary, ["_open"])
    number = F.col("_here") - F.coalesce("_closed", -F.coalesce("_open", F.lit(0)))
    return joined.withColumn(out, number).drop(PART, "_here", "_closed", "_open")


def running_max_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add the largest ``value`` among the earlier rows of the group (null if none)."""
    parts = _Parts(df, keys, order)
    earlier = F.max("_max").over(_earlier(parts.across()))
    summary = parts.summary(F.max(value).alias("_max")).withColumn("_carry", earlier)
    here = F.max(value).over(_earlier(parts.local()))
    joined = parts.carry(parts.rows.withColumn("_here", here), summary, ["_carry"])
    return joined.withColumn(out, F.greatest("_carry", "_here")).drop(PART, "_carry", "_here")


def next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add ``value`` of the next row of the group (null at the end)."""
    parts = _Parts(df, keys, order)
    summary = parts.summary(F.min_by(F.struct(value), F.struct(*order)).alias("_first"))
    summary = summary.withColumn("_carry", F.lead("_first").over(parts.across()))
    here = F.lead(F.struct(value)).over(parts.local())
    joined = parts.carry(parts.rows.withColumn("_here", here), summary, ["_carry"])
    found = F.coalesce("_here", "_carry")
    return joined.withColumn(out, found.getField(value)).drop(PART, "_carry", "_here")
