"""A long-only top-quantile portfolio on a dense panel (t, trade_date, code, f, close), f NULL where missing.

A panel, and all that follows from it, may carry factor_id and top_pct: each pair of them is a portfolio of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("factor_id", "top_pct")


def keys(rows: DataFrame) -> list[str]:
    return [k for k in KEYS if k in rows.columns]


def by_code(rows: DataFrame) -> Window:
    return Window.partitionBy(*keys(rows), "code").orderBy("t")


def placed(panel: DataFrame, direction: int = 1) -> DataFrame:
    """panel with the number of values of the date and the place of each among them, best first: the same for all portfolio sizes."""
    own = [*keys(panel), "trade_date"]
    same = Window.partitionBy(*own, F.col("f").isNull())
    place = F.row_number().over(same.orderBy((F.col("f") * direction).desc(), "code"))
    return panel.withColumns({"_n": F.count("f").over(Window.partitionBy(*own)), "_place": place})


def top_weights(panel: DataFrame, top: float | Column, every: int = 5, direction: int = 1) -> DataFrame:
    """panel with w: on each ``every``-th calendar row the best names share the weight, in between and on days
    without any value the last weights stay."""
    panel = panel if "_place" in panel.columns else placed(panel, direction)
    turn, n, place = F.pmod(F.col("t") - 1, F.lit(every)) == 0, F.col("_n"), F.col("_place")
    k = F.greatest(F.lit(1), F.floor(n * top))
    fresh = F.when(turn & (n > 0), F.when(F.col("f").isNotNull() & (place <= k), 1.0 / k).otherwise(0.0))
    held = F.last("_w", ignorenulls=True).over(by_code(panel).rowsBetween(Window.unboundedPreceding, 0))
    return panel.withColumn("_w", fresh).withColumn("w", F.coalesce(held, F.lit(0.0))).drop("_w", "_n", "_place")


def returns(weighted: DataFrame, fee_bps: float = 10.0, slip_bps: float = 5.0) -> DataFrame:
    """(keys, t, trade_date, gross, turnover, net), dated by the day on which the return is earned; the last row has none."""
    own = by_code(weighted)
    earned = F.coalesce(F.when(F.col("close") != 0, F.col("w") * (F.lead("close").over(own) / F.col("close") - 1)), F.lit(0.0))
    change = F.abs(F.lead("w").over(own) - F.col("w"))
    rows = weighted.withColumns({"_g": earned, "_c": change, "_d": F.lead("trade_date").over(own)}).filter("_d is not null")
    daily = rows.groupBy(*keys(weighted), "t", F.col("_d").alias("trade_date")).agg(F.sum("_g").alias("gross"), F.sum("_c").alias("turnover"))
    return daily.withColumn("net", F.col("gross") - F.col("turnover") * (fee_bps + slip_bps) / 1e4)


def equity(daily: DataFrame) -> DataFrame:
    """daily with equity, the product of 1 + net so far, whatever the signs: 0 from a total loss on. A portfolio has one
    row a date; without keys the curve is one portfolio's."""
    order = Window.partitionBy(*keys(daily)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    grown = 1 + F.col("net")
    size = F.exp(F.sum(F.when(grown != 0, F.ln(F.abs(grown)))).over(order))
    sign = F.when(F.pmod(F.count_if(grown < 0).over(order), F.lit(2)) == 1, -1.0).otherwise(1.0)
    return daily.withColumn("equity", F.when(F.count_if(grown == 0).over(order) > 0, 0.0).otherwise(sign * size))


def stats(daily: DataFrame, train_end: str, test_start: str) -> DataFrame:
    """One row a portfolio: total return, drawdown and win rate of all days; yearly figures of the training days; test figures."""
    order = Window.partitionBy(*keys(daily)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    curve = equity(daily)
    curve = curve.withColumn("peak", F.greatest(F.max("equity").over(order), F.lit(1.0)))
    train, test = F.when(F.col("trade_date") <= train_end, F.col("net")), F.when(F.col("trade_date") >= test_start, F.col("net"))
    year = lambda x: F.avg(x) * 252
    vol = lambda x: F.stddev_pop(x) * F.sqrt(F.lit(252.0))
    out = curve.groupBy(*keys(daily)).agg(
        (F.max_by("equity", "t") - 1).alias("total_return"),
        F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"),
        F.avg((F.col("net") > 0).cast("double")).alias("win_rate"),
        year(train).alias("ann_return"),
        vol(train).alias("ann_vol"),
        F.when(vol(train) > 0, year(train) / vol(train)).alias("sharpe"),
        year(test).alias("test_ann_return"),
        F.when(vol(test) > 0, year(test) / vol(test)).alias("test_sharpe"),
        F.avg("turnover").alias("avg_turnover"),
    )
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("ann_return") / -F.col("max_drawdown")))


def directions(summary: DataFrame) -> DataFrame:
    """(factor_id, direction): 1 where the mean rank IC is not negative, else -1, also where there is none."""
    return summary.select("factor_id", F.when(F.col("mean_rank_ic") >= 0, 1).otherwise(-1).alias("direction"))


def run(long: DataFrame, summary: DataFrame, tops: tuple[float, ...] = (0.05, 0.10), every: int = 5, **costs: float) -> DataFrame:
    """(factor_id, top_pct, t, trade_date, gross, turnover, net) of all factors of a long panel (factor_id, t, trade_date,
    code, f, close) that have a row in summary, which is a row a factor, in the direction of their rank IC."""
    told = long.join(F.broadcast(directions(summary)), "factor_id").withColumn("f", F.col("f") * F.col("direction"))
    told = placed(told.select("factor_id", "t", "trade_date", "code", "f", "close"))
    cells = told.select("factor_id", F.explode(F.array(*[F.lit(t) for t in tops])).alias("top_pct"), "t", "trade_date", "code", "f", "close", "_n", "_place")
    return returns(top_weights(cells, F.col("top_pct"), every), **costs)
