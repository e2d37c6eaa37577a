"""A validation run: the best factors of a mining run on the whole market, with groups, backtest and clean tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfactor.functions.features import PUBLIC
from loomfactor.operators import backtest, diagnostics, groups, metrics
from loomfactor.operators.panel import densify, forward_return
from loomfactor.plans.compile import evaluate, long_form
from loomfactor.plans.expressions import Call, Expr, Field, Limits, Validator, parse
from loomfactor.sources.tables import write_report


@dataclass(frozen=True)
class Config:
    fields: tuple[str, ...] = tuple(PUBLIC)
    windows: tuple[int, ...] = (10, 20, 30, 40, 50)
    #: Looser than in mining.
    limits: Limits = Limits(depth=6, nodes=16)
    horizon: int = 5
    least: int = 30
    least_bucket: int = 50
    train_end: str = "20241231"
    test_start: str = "20250101"
    tops: tuple[float, ...] = (0.05, 0.10)
    every: int = 5
    fee_bps: float = 10.0
    slip_bps: float = 5.0
    clean: int = 5
    max_loss: float = 0.45


def _fields(expr: Expr) -> set[str]:
    return {expr.name} if isinstance(expr, Field) else set().union(*map(_fields, expr.args)) if isinstance(expr, Call) else set()


def factor_panels(features: DataFrame, factors: DataFrame, config: Config, raw: str) -> tuple[DataFrame, DataFrame]:
    """(status, long): (factor_id, expr, status) of every factor, and (factor_id, t, trade_date, code, f, fwd, close,
    circ_mv, industry) of those that can be evaluated. What the factors read of the features is written to raw: calendar, codes,
    facts and industries are taken from there."""
    validator, status, trees = Validator(set(config.fields), config.windows, config.limits), [], {}
    for r in factors.collect():  # a list of at most some hundred factors
        try:
            tree = parse(r.expr)
            told = validator.check(tree)
        except ValueError as e:
            tree, told = None, str(e)
        status.append((r.factor_id, r.expr, told))
        if told == "OK":
            trees[r.factor_id] = tree
    spark = features.sparkSession
    if "industry" not in features.columns:
        features = features.withColumn("industry", F.lit(None).cast("string"))
    read = set().union(*map(_fields, trees.values()))
    fields = [f for f in config.fields if f in features.columns and f in read]
    features = _written(features.select("code", "trade_date", "industry", *dict.fromkeys([*fields, "close", "circ_mv"])), raw)
    panel = densify(features, [*fields, "close", "circ_mv"]).withColumn("fwd", forward_return(config.horizon))
    keep = ["fwd", "close", "circ_mv"]
    wide = evaluate(panel, trees, keep)
    long = long_form(wide, list(trees), keep).withColumnRenamed("expr_id", "factor_id")
    named = long.join(F.broadcast(groups.industry_map(features)), "code", "left").withColumn("industry", F.coalesce("industry", F.lit("UNKNOWN")))
    return spark.createDataFrame(status, "factor_id string, expr string, status string"), named


def run(features: DataFrame, factors: DataFrame, config: Config, out: str) -> dict[str, DataFrame]:
    """Write (as Parquet, and reports as CSV too) and return status, summary, rolling IC, size and industry groups (of the first factor, as they stand for the
    market), portfolio summary, equity curves, and clean tables of the first factors with their aggregates."""
    spark = features.sparkSession
    status, long = factor_panels(features, factors, config, f"{out}/raw")
    long.write.mode("overwrite").partitionBy("factor_id").parquet(f"{out}/panels")
    long = spark.read.schema(long.schema).parquet(f"{out}/panels")
    scored = long.withColumnRenamed("factor_id", "expr_id")
    # Ranked once; the scores are a row a factor and date.
    days = _written(metrics.daily(scored, "average"), f"{out}/daily")
    summary = metrics.summarise(days, config.least, config.train_end, config.test_start).withColumnRenamed("expr_id", "factor_id")
    summary = _written(summary, f"{out}/factor_metrics_summary")
    found = {
        "factor_compute_status": status,
        "factor_metrics_summary": summary,
        "rolling_ic": metrics.rolling_ic_of(days).withColumnRenamed("expr_id", "factor_id"),
    }
    order = status.filter("status = 'OK'").select("factor_id").orderBy("factor_id").limit(config.clean)
    first = [r.factor_id for r in order.collect()]
    one = long.filter(F.col("factor_id") == first[0]) if first else long.limit(0)
    found["group_metrics_by_size"] = groups.size_metrics(groups.size_bucket(one, least=config.least_bucket))
    found["group_metrics_by_industry"] = groups.industry_metrics(one)
    daily = _written(backtest.run(long, summary, config.tops, config.every, fee_bps=config.fee_bps, slip_bps=config.slip_bps), f"{out}/portfolio_returns")
    curve = backtest.equity(daily)
    stats = backtest.stats(daily, config.train_end, config.test_start).join(backtest.directions(summary), "factor_id")
    found |= {"portfolio_summary": stats, "equity_curves": curve.select("factor_id", "top_pct", F.col("trade_date").alias("date"), "equity")}
    for name in first:
        cells = long.filter(F.col("factor_id") == name)
        table = _written(diagnostics.clean_factor(cells, keep=["industry"]), f"{out}/clean/{name}")
        if diagnostics.loss(cells, table) <= config.max_loss:
            found[f"quantile_returns_{name}"] = diagnostics.quantile_returns(table)
            found[f"ic_by_period_{name}"] = diagnostics.ic_by_period(table)
    done = ("factor_metrics_summary",)
    found = {name: table if name in done else _written(table, f"{out}/{name}") for name, table in found.items()}
    for name, table in found.items():  # a row a factor, date or group: reports are read as CSV
        write_report(table, f"{out}/csv/{name}")
    return found


def _written(table: DataFrame, path: str) -> DataFrame:
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
