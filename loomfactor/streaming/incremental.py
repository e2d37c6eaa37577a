"""Incremental loads: new files are merged into a keyed table by the latest version of each key.

``follow`` appends what it finds; ``follow_once`` is stateful: it knows the rows of the last while (an event-time watermark) and
lets a row through once, however often files repeat it. Rows that arrive after the watermark has passed them are late: they do
not enter the table, as nobody knows any more whether they have been there, and ``late`` lists them, so that a backfill can
decide. A restart goes on from the checkpoint with the same watermark and the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the one of the highest version."""
    last = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def beyond(rows: DataFrame, loaded: DataFrame, date: str) -> DataFrame:
    """Rows later than the high-water mark of what has been loaded."""
    mark = loaded.agg(F.max(date).alias("mark"))
    return rows.join(F.broadcast(mark), F.col("mark").isNull() | (F.col(date) > F.col("mark"))).drop("mark")


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch of new Parquet files under its batch number; readers take newest() over it.

    A batch that is replayed overwrites its own partition, so it counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_once(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], time: str, delay: str = "3 days"
) -> StreamingQuery:
    """Append each row of new Parquet files once by its keys (the version among them), unless it is more than ``delay``
    older than the newest row before it. A micro-batch that is replayed overwrites its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source).withWatermark(time, delay)
    once = stream.dropDuplicatesWithinWatermark(keys)
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late(arrived: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the source, each once by its keys, that the table has not taken."""
    return arrived.join(loaded.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
