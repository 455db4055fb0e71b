"""Shared-folder tables: how the operators of this package cut lineage."""
from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests on one machine) gets a temporary folder; any other is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="adlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def dropped(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are done: it does so once neither Python nor the JVM knows their frames.

    The gateway between the two lets go of its own references only after a first collection.
    """
    gc.collect()
    for pause in (0.3, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def stored_at(df: DataFrame, name: str, kept: bool = False, release: bool = True) -> tuple[DataFrame, str]:
    """``stored``, and the path of the table, which outlives the ``scratch`` around it if ``kept``.

    Without ``release``, shuffle files of done steps wait for the next table's collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes and not kept:
        _scopes[-1].append(path)
    if release:
        released(spark)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    A lost executor then costs a reread of that table, not of what came before.
    """
    return stored_at(df, name)[0]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at the end, but for those stored as ``kept``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            dropped(spark, path)


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Hand texts to Python workers in Arrow batches of at most ``most`` bytes or one row, in place of Spark's 64 MB.

    A session that names another bound keeps it.
    """
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, f"{most}b")
