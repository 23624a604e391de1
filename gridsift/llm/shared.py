"""Tables kept in the folder all executors share, and sums that run over sorted rows of any number."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.session import checkpoint_dir, delete_at_end

PART = "_part"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """A name for each of ``wanted`` that no column of ``df`` has, in any letter case; the name itself where it is free."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its plain name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name of its own below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read from there: it survives lost executors.

    The folder goes when the application ends.
    """
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Add, for each ``sums[value] = out``, the sum of ``value`` over the earlier rows of the row's group.

    ``keys`` (may be empty) must not be null; ``order`` must be total in a group, up
    to rows that are equal throughout.  The rows are range-partitioned by group and
    order, so a large group is cut into parts; each part is summed on its own, and
    one row per part and group carries the totals across the cuts.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    rows = saved(ranged.withColumn(PART, F.spark_partition_id()), "ranged")
    totals = rows.groupBy(PART, *keys).agg(*[F.sum(v).alias(f"_all_{v}") for v in sums])
    parts = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(PART, *keys, *[F.coalesce(F.sum(f"_all_{v}").over(parts), F.lit(0)).alias(f"_on_{v}") for v in sums])
    here = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.coalesce(F.sum(v).over(here), F.lit(0)).alias(f"_in_{v}") for v in sums])
    joined = local.join(carried, [PART, *keys])
    return joined.select(*df.columns, *[(F.col(f"_on_{v}") + F.col(f"_in_{v}")).alias(out) for v, out in sums.items()])
