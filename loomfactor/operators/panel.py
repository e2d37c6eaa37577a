"""Dense panels in long form: one row per calendar date and code, a column per field, NULL where a fact is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfactor.functions.missing import clean


def calendar(facts: DataFrame) -> DataFrame:
    """(trade_date, t): the distinct dates, numbered from 1. One row per date, so one small partition."""
    dates = facts.select("trade_date").distinct()
    return dates.withColumn("t", F.row_number().over(Window.orderBy("trade_date")))


def densify(facts: DataFrame, fields: list[str]) -> DataFrame:
    """(t, trade_date, code, fields...): every date for every code, both as the facts list them. The facts of a code lie in order,
    and each gives the rows up to the next one too, the first also those before it: the grid is not built apart and joined."""
    days = calendar(facts).withColumn("_days", F.count("*").over(Window.partitionBy()))
    rows = facts.select(F.col("trade_date").alias("_date"), "code", *[F.col(f).alias(f"_at_{f}") for f in fields])
    rows = rows.join(F.broadcast(days.withColumnRenamed("t", "_t")), F.col("_date").eqNullSafe(F.col("trade_date"))).drop("trade_date")
    own = Window.partitionBy("code").orderBy("_date")
    rows = rows.withColumns({"_before": F.lag("_t").over(own), "_next": F.lead("_t").over(own)})
    # Facts without a date or code are listed, but not known: a cell of them stands once, and empty.
    known = F.col("_date").isNotNull() & F.col("code").isNotNull()
    again = ~known & (F.col("_before") == F.col("_t"))
    first = F.when(F.col("_before").isNull(), 1).when(again, F.col("_t") + 1).otherwise(F.col("_t"))
    last = F.greatest(F.coalesce(F.col("_next"), F.col("_days") + 1) - 1, F.col("_t")).cast("int")
    cells = rows.withColumn("_known", known).withColumn("t", F.explode(F.when(first <= last, F.sequence(first, last))))
    here = F.col("_known") & (F.col("t") == F.col("_t"))
    found = cells.select("t", "code", *[F.when(here, F.col(f"_at_{f}")).alias(f) for f in fields])
    return found.join(F.broadcast(days), "t").select("t", "trade_date", "code", *fields)


def by_code() -> Window:
    return Window.partitionBy("code").orderBy("t")


def forward_return(horizon: int = 5, close: str = "close") -> Column:
    """Return to the close ``horizon`` calendar rows ahead; the last rows have none."""
    ahead = F.lead(close, horizon).over(by_code())
    return clean(F.when(F.col(close) != 0, ahead / F.col(close) - 1))
