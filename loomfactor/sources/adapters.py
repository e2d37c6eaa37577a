"""Keyed panels derived from the supplied star-schema tables: (code, trade_date 'yyyyMMdd', measures...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(x: Column, unit: str) -> Column:
    return F.date_format(F.date_trunc(unit, x), "yyyyMMdd")


def bars(spark: SparkSession, sf_dir: str, code: str = "l_suppkey") -> DataFrame:
    """Monthly bars of the unit price of line items, with flow by order size and the distribution of prices. Items are dealt by code
    before they are added up: parts of the few items that a code and month have are no smaller than the items, and what follows for
    each code needs no further exchange."""
    kept = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    order = F.struct(*kept)
    qty, price = F.col("l_quantity"), F.col("price")
    items, few = read(spark, sf_dir, "lineitem"), code in ("p_size", "p_brand")
    if few:
        part = read(spark, sf_dir, "part").select("p_partkey", code)
        items = items.join(part, items.l_partkey == part.p_partkey)
    items = items.select(
        F.col(code).cast("string").alias("code"), F.date_trunc("month", "l_shipdate").alias("month"), (F.col("l_extendedprice") / qty).alias("price"),
        qty, "l_extendedprice", "l_linestatus", *kept,
    )
    # The many items of few codes are added up where they lie.
    items = items if few else items.repartition("code")
    tiers = {"sm": qty <= 10, "md": (qty > 10) & (qty <= 30), "lg": qty > 30}
    sides = {"buy": "O", "sell": "F"}
    flow = [
        F.sum(F.when(tier & (F.col("l_linestatus") == status), F.col("l_extendedprice")).otherwise(0.0)).alias(f"{side}_{t}_amount")
        for t, tier in tiers.items()
        for side, status in sides.items()
    ]
    cuts = [0.05, 0.15, 0.5, 0.85, 0.95]
    out = items.groupBy("code", "month").agg(
        F.min_by(price, order).alias("open"),
        F.max_by(price, order).alias("close"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.sum(qty).alias("vol"),
        F.sum("l_extendedprice").alias("amount"),
        (F.sum(price * qty) / F.sum(qty)).alias("weight_avg"),
        F.percentile(price, F.array(*[F.lit(c) for c in cuts])).alias("cuts"),
        *flow,
    )
    out = out.select("code", F.date_format("month", "yyyyMMdd").alias("trade_date"), *[c for c in out.columns if c not in ("code", "month")])
    own = Window.partitionBy("code").orderBy("trade_date")
    past = own.rowsBetween(Window.unboundedPreceding, 0)
    named = {f"cost_{round(100 * c)}pct": F.col("cuts")[i] for i, c in enumerate(cuts)}
    return out.withColumns(
        named
        | {
            "pre_close": F.lag("close").over(own),
            "net_mf_amount": F.expr("buy_md_amount + buy_lg_amount - sell_md_amount - sell_lg_amount"),
            "his_low": F.min("low").over(past),
            "his_high": F.max("high").over(past),
            "winner_rate": F.when(F.col("high") > F.col("low"), 100 * (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))),
            "turnover_rate": F.col("vol") / 100,
            "turnover_rate_f": F.col("vol") / 80,
            "volume_ratio": F.col("vol") / F.avg("vol").over(own.rowsBetween(-4, 0)),
            "circ_mv": F.sum("amount").over(past),
        }
    ).drop("cuts")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean event value of each user: a sparse panel."""
    rows = read(spark, sf_dir, "events")
    return rows.groupBy(F.col("user_id").cast("string").alias("code"), _day(F.col("ts"), "day").alias("trade_date")).agg(
        F.avg("value").alias("close"), F.count("*").cast("double").alias("vol")
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, name, industry) of suppliers, the region standing for an industry."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("name"), F.col("r_name").alias("industry")
    )
