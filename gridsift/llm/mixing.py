"""Mixing sources to target weights.

Each source's documents get hash-random keys and are range-sorted by them; running
sums of sizes over the sorted rows tell where the source's budget is used up.  A
budget beyond the source's size takes whole epochs first and cuts in the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.llm.shared import free_names, quoted, running_sums, saved
from gridsift.llm.words import WORD

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def budgets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of ``sizes`` (source_key, source_size): its columns and ``target``.

    Sources in order of ``source_key`` take the weights in turn.  They share
    ``share`` of all sizes by weight; no target exceeds ``most`` times the source's
    size, and what a source cannot take goes to the others by weight.  A source is at
    its limit exactly if its limit per weight is at most the level that the sources
    of a higher limit per weight would share, so one pass over the sources in that
    order settles all targets.
    """
    sizes = sizes.withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sums(sizes, [], ["source_key"], {"_one": "_rank"})
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = ranked.select("source_key", "source_size", turn.alias("_w"), (F.col("source_size") * most).alias("_cap"))
    ranked = saved(ranked.withColumn("_ratio", F.col("_cap") / F.col("_w")), "sources")
    whole = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("_w"), F.lit(0)).alias("weights")).first()
    pool = share * whole["words"]
    ordered = running_sums(ranked, [], ["_ratio", "source_key"], {"_cap": "_caps", "_w": "_ws"})
    full = F.col("_cap") * (F.lit(whole["weights"]) - F.col("_ws")) <= F.col("_w") * (F.lit(pool) - F.col("_caps"))
    ordered = saved(ordered.withColumn("_full", full), "sources")
    used = ordered.agg(F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))), F.lit(0)).alias("words"), F.sum(F.when(~F.col("_full"), F.col("_w"))).alias("weights")).first()
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.lit(pool - used["words"]) / F.lit(used["weights"] or 1))
    return ordered.select("source_key", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = "mix",
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, copies.

    ``size`` is the number of words (null text: 0).  ``taken`` is the number of
    words the mix takes of the row, whole epochs and the cut together; the taken
    words of a source add up to its target without the fraction.  ``copies`` rounds
    the cut to whole documents.  Sources are ordered by code point, a null source
    last.  The order within a source is the MD5 of seed and id, then the id; rows
    that repeat an id are cut together in any order.  Sources without words get target 0.
    ``row_col`` names a column of row numbers that is to stand in the result: it tells
    rows of one id (or of no id) apart.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    name = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name"))
    row = ["row"] if row_col else []
    own = [F.col(row_col).alias("row")] if row_col else []
    sized = saved(docs.select(F.col(id_col).alias("id"), words_in(F.col(text_col)).alias("size"), name.alias("source_key"), key.alias("key"), *own), "sized")
    targets = budgets(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, share, most)
    placed = running_sums(sized, ["source_key"], ["key", "id", "size", *row], {"size": "before"})
    # One row per source; where sources are many, the join is a shuffle on both sides and splits large ones at run time.
    both = placed.join(targets, "source_key")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    both = both.withColumn("epochs", epochs).withColumn("rest", rest - F.col("before"))
    cut = F.greatest(F.lit(0), F.least("size", "rest"))
    more = ((F.col("rest") > 0) & (2 * F.col("rest") >= F.col("size"))).cast("long")
    return both.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"), (F.col("epochs") + more).alias("copies"),
        *[F.col("row").alias(row_col) for _ in row],
    )


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it whole.

    Rows are numbered once, and each meets its own copies by that number, so ids may
    repeat or be null.  All columns come out as they went in, whatever their names.
    """
    row, copies, n = free_names(docs, "_row", "_copies", "_n")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    counts = mix(rows, id_col, source_col, text_col, row_col=row, **settings).select(F.col(row), F.col("copies").alias(copies))
    chosen = rows.join(counts.where(F.col(copies) > 0), row)
    repeated = chosen.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return repeated.select(*[quoted(c) for c in docs.columns])
