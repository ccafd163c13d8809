"""Session helpers: local test session and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Tables written by cut_lineage, by application.
_WRITTEN: dict[str, list[str]] = {}
# The folder of each re-read table.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("meshloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


# Spark's own switch for deleting the shuffle files of a query at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files: their result is a table, so nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame, frees: Iterable[DataFrame | None] = ()) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and return the re-read table.

    ``frees`` names tables of earlier calls that nothing needs once this one is written; they
    are deleted then.

    A Parquet table is computed once, is pruned by column when read again, and gives the
    optimizer real sizes. The folder is the cluster's ``spark.checkpoint.dir``. Only a local
    master may fall back to a private folder; a cluster without the setting is an error,
    because executors could not see such a folder.
    """
    path = scratch_folder(df.sparkSession)
    with shuffle_files_freed(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    for old in frees:
        drop_cut(old)
    return table


def scratch_folder(spark: SparkSession) -> str:
    """A new path below the checkpoint folder; `remove_cuts` deletes what is written there."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.setCheckpointDir(folder)
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    _WRITTEN.setdefault(context.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_cut(table: DataFrame | None) -> bool:
    """Delete a table that `cut_lineage` returned; frames built on it can't be read afterwards."""
    path = _FOLDERS.pop(table, None) if table is not None else None
    if path is None:
        return False
    _delete(table.sparkSession, path)
    written = _WRITTEN.get(table.sparkSession.sparkContext.applicationId, [])
    if path in written:
        written.remove(path)
    return True


def remove_cuts(spark: SparkSession) -> int:
    """Delete the tables that `cut_lineage` wrote for this application; call it once their results are stored."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        _delete(spark, name)
    return len(paths)
