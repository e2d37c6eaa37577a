"""Clean factor tables and the aggregates of a tear sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfactor.operators.metrics import daily
from loomfactor.operators.panel import forward_return


def clean_factor(panel: DataFrame, periods: tuple[int, ...] = (1, 5, 10), quantiles: int = 5, keep: list[str] = ()) -> DataFrame:
    """(trade_date, code, factor, period_p..., factor_quantile, keep...): rows with the factor and all forward returns, by
    the date's quantile edges (linear interpolation, upper edge included)."""
    rows = panel.withColumns({f"period_{p}": forward_return(p) for p in periods})
    rows = rows.dropna(subset=["f", *[f"period_{p}" for p in periods]])
    cuts = [F.lit(i / quantiles) for i in range(1, quantiles)]
    edges = F.percentile("f", F.array(*cuts)).over(Window.partitionBy("trade_date"))
    rows = rows.withColumn("_edges", edges)
    quantile = 1 + F.size(F.filter("_edges", lambda e: F.col("f") > e))
    return rows.select("trade_date", "code", F.col("f").alias("factor"), *[f"period_{p}" for p in periods], quantile.cast("int").alias("factor_quantile"), *keep)


def loss(panel: DataFrame, cleaned: DataFrame) -> float:
    """Share of factor values that the clean table lost."""
    before = panel.filter("f is not null").count()
    return 1 - cleaned.count() / before if before else 0.0


def quantile_returns(cleaned: DataFrame) -> DataFrame:
    periods = [c for c in cleaned.columns if c.startswith("period_")]
    return cleaned.groupBy("factor_quantile").agg(*[F.avg(c).alias(f"mean_{c}") for c in periods], F.count("*").alias("n"))


def ic_by_period(cleaned: DataFrame) -> DataFrame:
    """(trade_date, period, ic) of a clean table: rank correlation, shared ties, of the factor with each forward return."""
    periods = [c for c in cleaned.columns if c.startswith("period_")]
    long = cleaned.unpivot(["trade_date", "code", "factor"], periods, "expr_id", "fwd")
    long = long.withColumns({"f": F.col("factor"), "t": F.lit(0)})
    return daily(long, "average").select("trade_date", F.col("expr_id").alias("period"), F.col("rank_ic").alias("ic"))


#: Trading days of a year, by which alpha is annualised.
YEAR = 252


def factor_returns(cleaned: DataFrame) -> DataFrame:
    """(trade_date, period, market, portfolio): mean return of the date, and that of a portfolio that holds each code in
    proportion to its factor less the date's mean, long and short together 1."""
    periods = [c for c in cleaned.columns if c.startswith("period_")]
    day = Window.partitionBy("trade_date")
    off = cleaned.withColumn("_w", F.col("factor") - F.avg("factor").over(day))
    long = off.unpivot(["trade_date", "code", "_w"], periods, "period", "r").groupBy("trade_date", "period")
    size = F.sum(F.abs("_w"))
    return long.agg(F.avg("r").alias("market"), F.when(size > 0, F.sum(F.col("_w") * F.col("r")) / size).alias("portfolio"))


def alpha_beta(cleaned: DataFrame, year: int = YEAR) -> DataFrame:
    """(period, n_dates, alpha, beta, ann_alpha, log_ann): the portfolio's return regressed on the market's by dates. The sums of the
    normal equations are added up where the rows lie; two numbers a period are solved for at the end. log_ann is the log of
    1 + ann_alpha, taken from alpha: a yearly loss of nearly all rounds ann_alpha to -1, which has no log."""
    days = factor_returns(cleaned).filter("market is not null and portfolio is not null")
    x, y = F.col("market"), F.col("portfolio")
    # Sums about the mean: those of squares would cancel.
    fit = days.groupBy("period").agg(F.count("*").alias("n_dates"), F.var_pop(x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    beta = F.when((F.col("n_dates") >= 2) & (F.col("xx") > 0), F.col("xy") / F.col("xx"))
    steps = F.regexp_extract("period", r"(\d+)$", 1).cast("double")
    fit = fit.withColumn("beta", beta).withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    grown = F.pow(1 + F.col("alpha"), year / steps)
    log_ann = F.when(F.col("alpha") > -1, year / steps * F.log1p("alpha")).otherwise(F.ln(grown))
    return fit.select("period", "n_dates", "alpha", "beta", (grown - 1).alias("ann_alpha"), log_ann.alias("log_ann"))


def quantile_turnover(cleaned: DataFrame, period: int = 1) -> DataFrame:
    """(trade_date, factor_quantile, n, turnover): of the codes in a quantile, the share that was not in it ``period`` dates of
    the table earlier; the first dates have none. Memberships meet by code and number of the date, so no date is gathered."""
    dates = cleaned.select("trade_date").distinct()
    numbered = dates.withColumn("_i", F.row_number().over(Window.orderBy("trade_date")))  # a row a date
    held = cleaned.join(numbered, "trade_date").select("trade_date", "_i", "code", "factor_quantile")
    before = held.select("code", (F.col("_i") + period).alias("_i"), F.col("factor_quantile").alias("_q"))
    met = held.join(before, ["code", "_i"], "left")
    new = F.coalesce(F.col("_q") != F.col("factor_quantile"), F.lit(True))
    out = met.groupBy("trade_date", "_i", "factor_quantile").agg(F.count("*").alias("n"), (F.count_if(new) / F.count("*")).alias("share"))
    return out.select("trade_date", "factor_quantile", "n", F.when(F.col("_i") > period, F.col("share")).alias("turnover"))
