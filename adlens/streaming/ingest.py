"""Extension: sightings as a stream of files, folded into history batch by batch.

Nothing is dropped for being late, as a watermark would: an older capture joins the history where it belongs, and the state is
rebuilt from it. A batch that is replayed changes nothing, since a sighting is known by advert and moment.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.merge import KEY, merge_batch, rebuild
from ..sources.versions import Manifests, VersionedTable


def sightings_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _history(spark: SparkSession, target: str, schema: StructType) -> VersionedTable:
    return VersionedTable(spark, target, schema, KEY)


def fold(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str):
    """Start the fold with all files that are there, then stop.

    The history is a versioned table: a batch rewrites the buckets of its adverts and no others, and its number is committed with it under the query's id, so a batch that is tried
    again after a failure is folded once. A folder with a history of the former layout (``history-0``, ``history-1``) is refused.
    """

    def there(path: str) -> bool:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    if any(there(f"{target}/history-{i}") for i in (0, 1)):
        raise ValueError(f"{target} has a history of the former layout")
    table = _history(spark, target, stream.schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        merge_batch(VersionedTable(session, target, table.schema, KEY), batch, session.sparkContext.getLocalProperty("sql.streaming.queryId"), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, target: str, last_batch: int | None = None) -> DataFrame:
    """The state after all batches that are committed (``last_batch`` is not needed any more)."""
    newest = Manifests(spark, target).latest()
    schema = spark.read.parquet(f"{target}/data/{next(iter(newest['files'].values()))}").schema
    return rebuild(_history(spark, target, schema).read())


def windowed(stream: DataFrame, interval: str = "7 days", start: str = "4 days") -> DataFrame:
    """Sightings a week (from Monday) and source."""
    return stream.groupBy(F.window("observed_at", interval, startTime=start), "source_key").agg(F.count(F.lit(1)).alias("n"))
