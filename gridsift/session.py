"""Session helpers: reliable checkpoints and a local session for tests."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this session.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    master, whose executors live in this process, may fall back to a temporary
    folder of this machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="gridsift-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there on.

    Survives the loss of executors, and makes later steps see one fixed result.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: The virtual machine leaves methods of more than 8,000 bytes to its interpreter.  Beyond this limit Spark makes many small
#: methods of a stage instead of one large one, as the cleaning and profiling of many cells in a row would be.
COMPILED_BYTES = "8000"


def prepare(spark: SparkSession) -> None:
    """The settings the operators count on for speed; results do not depend on them."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of what runs meanwhile go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in the file system its path names."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location))


def subfolders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names right below a folder, unescaped (none if there is no folder)."""
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(location):
        return []
    plain = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    names = [status.getPath().getName() for status in system.listStatus(location)]
    return [plain(name[len(prefix):]) for name in names if name.startswith(prefix)]


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that exists when the application ends."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(location)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def move_file(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file within its file system, making the folder; false if there is nothing to move."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path(source)):
        return False
    system.mkdirs(path(target).getParent())
    return bool(system.rename(path(source), path(target)))


def ship_package(spark: SparkSession) -> None:
    """Give the package to the executors' Python workers, once per session.

    Functions that run in workers are found there by the name of their module; a
    worker on another machine, or started in another folder, cannot import it else.
    """
    context = spark.sparkContext
    if getattr(context, "_gridsift_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="gridsift-package-"), "gridsift_package.zip")
    with zipfile.ZipFile(archive, "w") as package:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    package.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._gridsift_shipped = True


def local_session(cpus: int | str = "*", name: str = "gridsift") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    parts = os.environ.get("GRIDSIFT_SHUFFLE_PARTITIONS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
