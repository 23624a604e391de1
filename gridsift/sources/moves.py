"""File moves made by tasks, after a plan that says where each file goes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsift.session import materialize, move_file, ship_package

PLAN_SCHEMA = "source string, archive_path string, archive_error string"
FILES_PER_TASK = 64


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path names, and the path in it; Hadoop's names of object stores are understood."""
    local = re.fullmatch(r"(?:file:)?/+(.*)", path, re.DOTALL)
    if local:
        return fs.LocalFileSystem(), "/" + local[1]
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def known(path: str) -> bool:
    """Whether tasks can open files of this path themselves."""
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError, OSError):
        return False
    return True


def move_one(source: str, target: str) -> str:
    """Move a file: ``moved``; ``done`` if an earlier try did; ``absent`` if it is in neither place; ``other`` if the system is not known here."""
    if not known(source):
        return "other"
    (system, old), (_, new) = opened(source), opened(target)
    there, made = (i.type != fs.FileType.NotFound for i in system.get_file_info([old, new]))
    if not there:
        return "done" if made else "absent"
    system.create_dir(new.rpartition("/")[0], recursive=True)
    try:
        # The plan gave this place to this file alone, so what lies there is the half of a copy.
        system.move(old, new)
    except FileNotFoundError:
        # Another attempt of this task was faster.
        return "done"
    return "moved"


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        state = [None if to is None else move_one(of, to) for of, to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(state, pa.string())], [*batch.schema.names, "state"])


def move_files(plan: DataFrame) -> DataFrame:
    """Carry out a plan (``source, archive_path, archive_error``) in tasks; returns it with ``state``.

    A file without a place is left alone (``state`` null).  A move that was made before is not made again, so
    a task, or the whole plan, can be run again at any time.  Files of systems that
    Arrow does not know are moved by the driver, one by one.
    """
    spark = plan.sparkSession
    ship_package(spark)
    tasks = max(1, -(-plan.count() // FILES_PER_TASK))
    spread = plan.select("source", "archive_path", "archive_error").repartition(tasks, "source")
    states = materialize(spread.mapInArrow(_moved, PLAN_SCHEMA + ", state string"))
    others = states.where("state = 'other'")
    for row in others.toLocalIterator():
        move_file(spark, row["source"], row["archive_path"])
    return states.withColumn("state", F.when(F.col("state") == "other", F.lit("moved")).otherwise(F.col("state")))
