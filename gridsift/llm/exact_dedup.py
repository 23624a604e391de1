"""Exact duplicates by a tree of merged digest runs, in DataFrame functions only.

Every input partition is a run of (digest, best row, count).  Runs meet in rounds:
in each round ``fan_in`` neighbouring runs are exchanged by digest, merged and
reduced to one row per digest, until one run is left, spread over all tasks by
digest.  A digest that holds a third of all rows thus has at most one row per run
in any exchange, and never more than ``fan_in`` rows per key after the first round.
The answers go down the same tree, so that no join key gathers the rows of a large
group either: rows meet them by (run, digest).

A digest is SHA-256; every level groups by the normalised length and a second hash
as well, so two texts pass as equal only if all three agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.llm.shared import free_names, quoted, saved
from gridsift.plans.joins import join_small

SPACES = r"[\x20\x09-\x0D]+"
RUNS = 64
FAN_IN = 8
SAME = ("digest", "same_length", "same_hash")


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def digest_runs(df: DataFrame, content: Column, best: Column, runs: int = RUNS) -> DataFrame:
    """``df`` with its run, its row number and the digests of ``content``; ``best`` sorts first what stays."""
    row = F.monotonically_increasing_id()
    return df.select(
        *df.columns,
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        row.alias("row"),
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"),
        F.octet_length(content).cast("long").alias("same_length"),
        F.xxhash64(content).alias("same_hash"),
        best.alias("best"),
    )


def merge_runs(rows: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Rows of ``digest_runs`` with ``winner`` (the best row of their group, with its row number) and ``group_size``.

    ``rows`` must be a saved table, since it is read once for the way up and once
    for the answers.  A row that is alone with its text is its own winner.
    """
    best = F.min(F.struct("best", "row")).alias("winner")
    levels = [saved(rows.groupBy("run", *SAME).agg(best, F.count(F.lit(1)).alias("n")), "run")]
    step = fan_in
    while True:
        up = levels[-1].groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), *SAME)
        levels.append(saved(up.agg(F.min("winner").alias("winner"), F.sum("n").alias("n")), "run"))
        if step >= runs:
            break
        step *= fan_in
    answer = levels.pop().where("n > 1").select(F.col("run").alias("above"), *SAME, F.col("winner"), F.col("n").alias("group_size"))
    for level in reversed(levels):
        own = level.select("run", F.floor(F.col("run") / fan_in).cast("int").alias("above"), *SAME)
        answer = own.join(answer, ["above", *SAME]).select(F.col("run").alias("above"), *SAME, "winner", "group_size")
    found = rows.join(answer.withColumnRenamed("above", "run"), ["run", *SAME], "left")
    alone = F.struct("best", "row")
    return found.withColumn("winner", F.coalesce("winner", alone)).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space (null is empty).
    Of equal texts the row with the most code points stays, then the one with the
    smallest id (a null id is last), then the first of rows that agree in both.
    An empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    best = F.struct((-F.length("text")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))
    rows = saved(digest_runs(slim, normalised(F.col("text")), best, runs).drop("text"), "digests")
    merged = merge_runs(rows, runs, fan_in)
    return merged.select(
        F.col("id").alias(id_col),
        F.col("winner.best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of rows that agree in id and text only one stays, and only if it wins its group; rows
    without id, and rows of one id with different texts, are told apart by their texts.
    """
    flags = copies(docs, id_col, text_col).select(F.col(id_col).alias("id"), "kept", F.col("text_sha256").alias("sha"))
    flags = saved(flags, "flags")
    seen = flags.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    unusual = seen.where("n > 1 OR id IS NULL").limit(1).count()
    if not unusual:
        losers = flags.where(~F.col("kept")).select(F.col("id").alias(id_col))
        return join_small(docs, losers, [id_col], "left_anti")
    own, by, sha = free_names(docs, "_own", "_id", "_sha")
    winners = flags.where("kept").select(F.col("id").alias(by), F.col("sha").alias(sha)).distinct()
    hashed = docs.withColumn(own, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    kept = hashed.join(winners, F.col(id_col).eqNullSafe(F.col(by)) & (F.col(own) == F.col(sha)), "left_semi")
    # One row for each id and text: the longest text, as the winner has, and any of those that agree in it.
    number, place = free_names(kept, "_number", "_place")
    numbered = saved(kept.withColumn(number, F.monotonically_increasing_id()), "winners")
    first = numbered.groupBy(id_col, own).agg(F.min_by(F.col(number), F.struct(-F.length(F.coalesce(F.col(text_col), F.lit(""))), F.col(number))).alias(place))
    return numbered.join(first.select(place), F.col(number) == F.col(place), "left_semi").select(*[quoted(c) for c in docs.columns])
