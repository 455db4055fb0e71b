"""Tables in the folder that driver and executors share: how operators of many rounds cut their lineage."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A local session without one gets a temporary folder; any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="adlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Stage:
    """Stored tables of one run; ``drop`` deletes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def folder(self, name: str) -> str:
        """A new folder's path, which goes with the tables."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        return path

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """All but the last ``keep`` tables go."""
        while len(self.paths) > keep:
            delete(self.spark, self.paths.pop(0))


@contextmanager
def stage(spark: SparkSession) -> Iterator[Stage]:
    """A stage whose tables are deleted at the end: only for results that don't read them any more."""
    out = Stage(spark)
    try:
        yield out
    finally:
        out.drop()


_left: dict[str, Stage] = {}


def fresh(spark: SparkSession, name: str) -> Stage:
    """The stage of a registered query whose result reads stored tables: they stay until the query is called again, which deletes them first."""
    if name in _left and _left[name].spark.sparkContext._jsc is not None:
        _left.pop(name).drop()
    return _left.setdefault(name, Stage(spark))
