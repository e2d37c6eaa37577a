"""Ranks of dates with more codes than a task should hold: every date is spread over tasks, by value.

Rows are dealt by ranges of (date, value, code) and sorted where they lie; ties are apart by code, so that even a date of one
value splits. A row's rank is its place in its part of the date, and what the parts before it hold. The sorted rows are
written before they are counted: both steps see the same parts, also when an executor is lost in between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of monotonically_increasing_id that number the rows of a partition.
_ROWS = 33


def rank_apart(
    panel: DataFrame, columns: dict[str, Column], keep: list[str], folder: str, parts: int | None = None, by: tuple[str, ...] = ("trade_date",)
) -> DataFrame:
    """The columns to keep, with an ordinal percentile among the values of the date (or of other groups) for each of
    columns, ties in the order of the code. A sort and a table under ``folder`` for each; ``parts`` is the number of tasks
    that share the rows."""
    spark = panel.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = panel.select(*keep, *[x.alias(n) for n, x in columns.items()])
    for name in columns:
        order = [*by, "_none", name, "code"]
        placed = rows.withColumn("_none", F.col(name).isNull()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        path = f"{folder}/rank-{uuid.uuid4().hex}"
        placed.withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
        read = spark.read.parquet(path)
        held = read.withColumn("_part", F.shiftright("_m", _ROWS)).withColumn("_row", F.col("_m").bitwiseAND(F.lit((1 << _ROWS) - 1)))
        sizes = held.groupBy(*by, "_none", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
        day = Window.partitionBy(*by, "_none")
        # A row a date and part: at most twice the dates and the parts together.
        before = F.sum("_n").over(day.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
        sizes = sizes.select(*by, "_none", "_part", "_first", before.alias("_before"), F.sum("_n").over(day).alias("_all"))
        met = held.join(sizes, [*by, "_none", "_part"])
        place = F.col("_row") - F.col("_first") + 1 + F.col("_before")
        rows = met.withColumn(name, F.when(~F.col("_none"), place / F.col("_all"))).select(*keep, *columns)
    return rows
