"""Reading a daily warehouse: table resolution, pools, the joined market table, simulated markets, factor files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve(spark: SparkSession, candidates: list[str]) -> str:
    """The first candidate that exists in the catalog, else the first."""
    return next((c for c in candidates if spark.catalog.tableExists(c)), candidates[0])


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """(code) of a file that holds one JSON array of strings."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("code")).distinct()


def market(
    daily: DataFrame,
    others: list[DataFrame],
    snapshot: DataFrame,
    start: str,
    end: str,
    pool: DataFrame | None = None,
    min_price: float | None = None,
) -> DataFrame:
    """Daily rows between two dates, of a pool or above a price, left-joined with the other daily tables and the
    snapshot. Filters come before the joins and reach the scan."""
    rows = daily.filter(F.col("trade_date").between(start, end))
    if min_price is not None:
        rows = rows.filter(F.col("close").isNotNull() & (F.col("close") > min_price))
    if pool is not None:
        rows = rows.join(pool, "code", "left_semi")
    for other in others:
        rows = rows.join(other, ["code", "trade_date"], "left")
    return rows.join(snapshot, "code", "left")


#: Names of simulated industries. Fixed values.
INDUSTRIES = ("电子", "医药", "机械", "化工", "计算机", "银行", "汽车", "电力")


def simulate(spark: SparkSession, days: int = 90, codes: int = 60, start: str = "2024-01-01", seed: int = 42) -> DataFrame:
    """A random market in which yesterday's flow moves today's price a little; business days, no holes. It has every
    column that features are made of; the draws are Spark's, the distributions those stated in FIXTURES.md."""
    dates = spark.sql(f"select explode(sequence(date'{start}', date_add(date'{start}', {2 * days + 10}))) as d")
    dates = dates.filter(F.dayofweek("d").between(2, 6)).withColumn("t", F.row_number().over(Window.orderBy("d"))).filter(F.col("t") <= days)
    grid = dates.crossJoin(spark.range(codes).select(F.col("id").alias("i")))
    number = iter(range(seed, seed + 100))
    normal = lambda sd=1.0: F.randn(next(number)) * sd
    uniform = lambda low, high: low + (high - low) * F.rand(next(number))
    # Draws are columns of their own, so that each is made once.
    draws = {
        "flow": normal(), "noise": normal(0.018), "gap": normal(0.006), "up": normal(0.01), "down": normal(0.01), "size": normal(0.5),
        "buy_sm": normal(0.2), "sell_sm": normal(0.2), "buy_md": normal(0.2), "sell_md": normal(0.2), "buy_lg": normal(0.2), "sell_lg": normal(0.2),
        "middle": normal(0.04), "mean": normal(0.02), "won": normal(10.0), "c5": uniform(0.05, 0.15), "c15": uniform(0.03, 0.10),
        "c85": uniform(0.03, 0.10), "c95": uniform(0.05, 0.15), "lowest": uniform(0.55, 0.9), "highest": uniform(1.1, 1.8),
        "turn": uniform(0.5, 8.0), "free": uniform(1.0, 2.0), "ratio": normal(0.5), "cap": normal(0.8), "total": uniform(1.0, 1.8),
    }
    rows = grid.select("t", F.date_format("d", "yyyyMMdd").alias("trade_date"), "i", F.format_string("%06d.SZ", "i").alias("code"), *[v.alias(k) for k, v in draws.items()])
    own, c = Window.partitionBy("code").orderBy("t"), F.col
    rows = rows.withColumn("base", F.exp(3.3 + 0.4 * F.first("size").over(own) / 0.5))
    rows = rows.withColumn("step", c("noise") + 0.0025 * F.coalesce(F.tanh(F.lag("flow").over(own)), F.lit(0.0)))
    rows = rows.withColumn("close", c("base") * F.exp(F.sum("step").over(own)))
    rows = rows.withColumns({"open": c("close") * (1 + c("gap")), "pre_close": F.coalesce(F.lag("close").over(own), c("close")), "vol": F.exp(12 + c("size"))})
    rows = rows.withColumns(
        {
            "high": F.greatest("open", "close") * (1 + F.abs("up")),
            "low": F.least("open", "close") * (1 - F.abs("down")),
            "pct_chg": (c("close") / c("pre_close") - 1) * 100,
            "amount": c("vol") * c("close") * 0.01,
            "cost_50pct": c("close") * (1 + c("middle")),
            "his_low": c("close") * c("lowest"),
            "his_high": c("close") * c("highest"),
            "turnover_rate": c("turn"),
            "turnover_rate_f": c("turn") * c("free"),
            "volume_ratio": F.exp("ratio"),
            "circ_mv": F.exp(6.5 + c("cap")),
            "total_mv": F.exp(6.5 + c("cap")) * c("total"),
            "industry": F.get(F.array(*[F.lit(x) for x in INDUSTRIES]), F.pmod("i", F.lit(len(INDUSTRIES))).cast("int")),
        }
    )
    sides = {}
    for tier, scale in (("sm", 0.7), ("md", 0.5), ("lg", 0.35)):
        for side, sign in (("buy", 1), ("sell", -1)):
            share = 0.5 + sign * scale * c("flow") * 0.2 + c(f"{side}_{tier}")
            sides[f"{side}_{tier}_amount"] = c("amount") * F.greatest(F.lit(0.01), share)
    middle = c("cost_50pct")
    costs = {
        "cost_5pct": middle * (1 - c("c5")), "cost_15pct": middle * (1 - c("c15")), "cost_85pct": middle * (1 + c("c85")),
        "cost_95pct": middle * (1 + c("c95")), "weight_avg": middle * (1 + c("mean")),
    }
    rows = rows.withColumns(sides | costs).withColumns(
        {
            "net_mf_amount": F.expr("buy_md_amount + buy_lg_amount - sell_md_amount - sell_lg_amount"),
            "winner_rate": F.least(F.greatest(50 + 300 * (c("close") / c("weight_avg") - 1) + c("won"), F.lit(0.0)), F.lit(100.0)),
        }
    )
    return rows.drop("i", "t", "base", "step", *draws)


def factor_ids(factors: DataFrame) -> DataFrame:
    """(factor_id, expr, score): a name for each distinct expression, best score first. A list of factors is what a run
    scored, small enough to be put in order by one task."""
    unique = factors.dropna(subset=["expr"]).groupBy("expr").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "expr"))
    name = F.concat(F.lit("F"), F.lpad(rank.cast("string"), 4, "0"), F.lit("_"), F.substring(F.md5("expr"), 1, 8))
    return unique.select(name.alias("factor_id"), "expr", "score")


def read_top_factors(spark: SparkSession, path: str, top: int | None = None) -> DataFrame:
    """(factor_id, expr, score) of a CSV of results, with or without a byte order mark: the canonical expressions if it
    has them, each once, best score first, at most ``top``."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.removeprefix("\ufeff") for c in rows.columns])
    score = F.col("score").try_cast("double") if "score" in rows.columns else F.lit(None).cast("double")
    column = "canonical" if "canonical" in rows.columns else "expr"
    ids = factor_ids(rows.select(F.col(column).alias("expr"), score.alias("score")))
    return ids.orderBy("factor_id").limit(top) if top is not None else ids


def read_factor(spark: SparkSession, path: str, factor_id: str) -> DataFrame:
    """One factor of a table partitioned by factor_id: only its partition is read."""
    return spark.read.parquet(path).filter(F.col("factor_id") == factor_id)


def write_factors(long: DataFrame, path: str) -> None:
    """All factor cells, missing ones included, partitioned by factor."""
    long.write.mode("overwrite").partitionBy("factor_id").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A table of results, a row an expression, factor or date, as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_pool(codes: DataFrame, path: str) -> None:
    """A pool (code) as one JSON array: a list of what is to be studied, of some hundred codes."""
    listed = codes.select("code").distinct().agg(F.to_json(F.array_sort(F.collect_list("code"))).alias("value"))
    listed.coalesce(1).write.mode("overwrite").text(path)
