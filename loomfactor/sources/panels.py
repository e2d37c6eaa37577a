"""Panels kept as tables that are bucketed by code: windows over a code and joins on code and date need no exchange."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from loomfactor.sources import files

KEY = ["code", "t"]
#: Joins on (code, t) may rely on rows that lie together by code alone.
_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def buckets_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def save(panel: DataFrame, name: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write a panel (code, t, ...) as a table of the catalog, one file a bucket, and return it as it is read. Without a path
    it lies in the warehouse. Panels that are to be joined need equal numbers of buckets."""
    n = buckets or buckets_of(panel.sparkSession)
    writer = panel.repartition(n, "code").write.mode("overwrite").format("parquet").bucketBy(n, "code").sortBy(*KEY)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return panel.sparkSession.table(name)


def drop(spark: SparkSession, name: str, path: str | None = None) -> None:
    """Forget a kept panel; the files of one that lies outside the warehouse are deleted by its path."""
    spark.sql(f"drop table if exists {name}")
    if path:
        files.delete(spark, path)


def attach(panel: DataFrame, more: DataFrame, columns: list[str]) -> DataFrame:
    """panel with columns of another kept panel of the same cells."""
    other = more.select(*KEY, *columns)
    return panel.join(other, KEY, "left")


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """While open, plans join kept panels where they lie."""
    before = spark.conf.get(_CO_PARTITION, "true")
    spark.conf.set(_CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(_CO_PARTITION, before)
