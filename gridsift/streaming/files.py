"""File streams: ingest, judging and delivery of batches and of tables that grow.

Every per-batch writer puts its result under ``batch_id=N`` with overwrite, so a
batch that is replayed after a crash replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gridsift.functions import file_stem, match_glob
from gridsift.operators import merging as M
from gridsift.operators.confidence import confidence, profile
from gridsift.operators.ledger import file_outcome
from gridsift.session import delete_folder, materialize, path_exists, subfolders
from gridsift.settings import OutputSettings, ScoreSettings, WatchSettings
from gridsift.sources.files import MEGABYTE, file_name, name_glob, too_large
from gridsift.sources.writers import archive_inputs, deliver

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(
    spark: SparkSession, watch: WatchSettings, since: datetime | None = None, archive: str | None = None
) -> DataFrame:
    """Files as they arrive: ``path, modificationTime, length, content, error``.

    A file beyond the size limit comes with an ``error`` and without content.  One source per folder.  Without ``process_existing`` files older than ``since``
    (default now) are skipped.  With ``archive`` a consumed file is moved there once
    a later batch has run; the folder must lie outside the watched ones.
    """
    streams = []
    error, limit = too_large(F.col("length"), watch.max_file_mb), int(watch.max_file_mb * MEGABYTE)
    for folder in watch.folders:
        reader = (
            spark.readStream.format("binaryFile")
            .schema(BINARY_SCHEMA)
            .option("maxFilesPerTrigger", watch.max_files_per_trigger)
        )
        if (glob := name_glob(watch.patterns)) is not None:
            reader = reader.option("pathGlobFilter", glob)
        if archive:
            reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
        if archive:
            # One source alone may move the files of a folder.
            files = reader.load(folder)
            streams.append(files.withColumn("content", F.when(error.isNull(), F.col("content"))).withColumn("error", error))
            continue
        # Lengths are known before contents: those of large files are never read.
        streams.append(reader.load(folder).where(F.col("length") <= limit).withColumn("error", F.lit(None).cast("string")))
        large = reader.load(folder).where(F.col("length") > limit).drop("content")
        streams.append(large.withColumn("content", F.lit(None).cast("binary")).withColumn("error", error))
    files = reduce(DataFrame.unionByName, streams)
    files = files.where(match_glob(file_name(F.col("path")), watch.patterns))
    # Not files below the folders, such as archived ones.
    inside = F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(file_name(F.col("path"))) - 1)
    files = files.where(reduce(lambda a, b: a | b, [inside.endswith(folder.rstrip("/")) for folder in watch.folders]))
    if not watch.process_existing:
        start = since or datetime.now(timezone.utc)
        files = files.where(F.col("modificationTime") >= F.lit(start))
    return files


def stream_rows(
    spark: SparkSession, folder: str, schema, kind: str = "parquet", max_files: int = 5, glob: str | None = None,
    archive: str | None = None,
) -> DataFrame:
    """Rows of data files as they arrive, a few files per trigger."""
    reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows written by earlier batches; ``batch_id`` comes from the folder names."""
    full = schema + ", batch_id bigint"
    if not path_exists(spark, path):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).option("recursiveFileLookup", False).parquet(path)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def _batch_numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in subfolders(spark, path, "batch_id=")]


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands every micro-batch to a callback; the caller picks the trigger."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)


def judge_batches(
    to_grid: Callable[[DataFrame], DataFrame],
    scores_path: str,
    deliver_path: str | None = None,
    settings: ScoreSettings = ScoreSettings(),
    output: OutputSettings = OutputSettings(),
    archive: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """Callback that judges, cleans and delivers the tables of each micro-batch.

    A table must be whole within a batch, as the sheets of a file are (``judge_growing``
    is for others).  With ``archive`` the files
    (``path`` of ``path#sheet``) that succeeded move to that subfolder of their own.

    Tables named ``path#sheet`` are delivered as ``file_sheet.csv``, others under their
    own name.  Each batch has its own folder, so names are settled within the batch
    and a replay writes the same files again.  A replay after files were moved does not
    see them any more: it keeps the scores and files that are there and completes the moves.
    """
    again = replace(output, include_timestamp=False)

    def work(batch: DataFrame, batch_id: int) -> None:
        # A stream keeps its id when it starts again; another one has batches of the same numbers.
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        moves = f"{scores_path}/_moves/{stream}/{batch_id}"
        if archive is not None and path_exists(batch.sparkSession, f"{moves}/_SUCCESS"):
            archive_inputs(batch.sparkSession, None, str(batch_id), archive, moves)
            return
        # The batch is read by several passes: keep it, files may be archived meanwhile.
        known = profile(materialize(to_grid(batch)))
        scores = materialize(confidence(known, settings))
        if deliver_path is not None:
            table = F.col("table_id")
            source = F.when(table.contains("#"), file_stem(file_name(F.substring_index(table, "#", 1))))
            done = deliver(
                known, scores, f"{deliver_path}/batch_id={batch_id}", str(batch_id),
                F.coalesce(source, F.lit("")), F.substring_index(table, "#", -1), again,
            )
        write_batch(scores, scores_path, batch_id)
        # The moves come last: their plan is committed when all else of the batch is.
        if archive is not None and deliver_path is not None:
            whole = scores.where(F.col("table_id").contains("#")).join(done, "table_id", "left")
            decisions = whole.select(
                F.substring_index("table_id", "#", 1).alias("source"), "accepted", F.coalesce("delivered", F.lit(False)).alias("delivered")
            )
            archive_inputs(batch.sparkSession, file_outcome(decisions), str(batch_id), archive, moves)

    return work


def kept_frames(spark: SparkSession, state_path: str, before: int | None = None) -> dict[str, DataFrame]:
    """What the batches below number ``before`` (all, if None) left of the tables they saw."""
    numbers = [n for n in _batch_numbers(spark, f"{state_path}/columns") if before is None or n < before]
    known = {name: read_batches(spark, f"{state_path}/{name}", schema, before) for name, schema in M.SCHEMAS.items()}
    last = F.col("batch_id") == F.lit(max(numbers, default=None))
    return {name: (df.where(last) if name in M.SMALL else df).drop("batch_id") for name, df in known.items()}


def grow_profiles(
    to_grid: Callable[[DataFrame], DataFrame], state_path: str, header: DataFrame | None = None, exact: bool = True
) -> Callable[[DataFrame, int], None]:
    """Callback that keeps merged profiles of tables whose rows are spread over batches.

    The rows of a batch are profiled once and merged with what the batches before left
    under ``state_path`` (``operators.merging``).  ``to_grid`` gives rows whose positions
    order a table over all batches and do not repeat; ``header`` holds rows, such as a row
    of names, that a table has in front and that join it with its first batch.

    The state has the size of the tables' columns, and is written anew by each batch; only
    the distinct values of unsettled columns grow, by what a batch has.  With
    ``exact=False`` these are estimated instead, and the state grows by tables only.  A
    replayed batch starts from the state before it.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = kept_frames(spark, state_path, batch_id)
        grid = to_grid(batch)
        if header is not None:
            new = grid.select("table_id").distinct().join(known["columns"].select("table_id").distinct(), "table_id", "left_anti")
            grid = grid.unionByName(header.join(new, "table_id", "left_semi"))
        fresh = M.part(materialize(grid), exact)
        merged = M.merged(known, fresh)
        for name in M.SCHEMAS:
            write_batch(merged[name] if name in M.SMALL else fresh[name], f"{state_path}/{name}", batch_id)
        # A replay of this batch needs the state before it; older ones are done with.
        for name in M.SMALL:
            for n in sorted(n for n in _batch_numbers(spark, f"{state_path}/{name}") if n < batch_id)[:-1]:
                delete_folder(spark, f"{state_path}/{name}/batch_id={n}")

    return work


def judge_kept(
    spark: SparkSession, state_path: str, settings: ScoreSettings = ScoreSettings(), tables: DataFrame | None = None, before: int | None = None
) -> DataFrame:
    """The scores of all tables (or of ``tables``, by ``table_id``) that ``grow_profiles`` keeps, by all their rows so far.

    Distinct values that were kept are counted here; nothing else grows with the rows.
    """
    known = kept_frames(spark, state_path, before)
    if tables is not None:
        known = {name: df.join(tables.select("table_id"), "table_id", "left_semi") for name, df in known.items()}
    return confidence(M.merged_profile(known), settings)


def judge_growing(
    to_grid: Callable[[DataFrame], DataFrame],
    state_path: str,
    scores_path: str,
    settings: ScoreSettings = ScoreSettings(),
    header: DataFrame | None = None,
    exact: bool = True,
) -> Callable[[DataFrame, int], None]:
    """``grow_profiles``, and the tables that got rows judged after each batch.

    Scores go to ``scores_path``, by batch, so the last ones of a table are those of all
    its rows so far (``last_scores``).
    """
    grow = grow_profiles(to_grid, state_path, header, exact)

    def work(batch: DataFrame, batch_id: int) -> None:
        grow(batch, batch_id)
        touched = to_grid(batch).select("table_id").distinct()
        write_batch(judge_kept(batch.sparkSession, state_path, settings, touched, batch_id + 1), scores_path, batch_id)

    return work


def last_scores(spark: SparkSession, scores_path: str) -> DataFrame:
    """The latest scores of every table that ``judge_growing`` judged."""
    rows = spark.read.option("basePath", scores_path).parquet(scores_path)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c not in ("table_id", "batch_id")]), "batch_id")
    return rows.groupBy("table_id").agg(newest.alias("_s")).select("table_id", "_s.*")


def heartbeat(spark: SparkSession) -> DataFrame:
    """A row without a path each second (``path, ts``).

    In union with the inputs of ``retry_events`` it makes due failures run on time when
    no new input arrives.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.select(F.lit(None).cast("string").alias("path"), F.col("timestamp").alias("ts"))


def run_available(writer: DataStreamWriter) -> None:
    """Process what has arrived, then stop; the checkpoint keeps the place."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
