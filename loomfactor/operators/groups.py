"""Groups of codes by size and by industry, and what expressions do inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = ("micro", "small", "mid", "large", "mega")


def size_bucket(panel: DataFrame, size: str = "circ_mv", least: int = 50) -> DataFrame:
    """panel with ``bucket`` 0..4 by the date's average-rank percentile of log size, -1 where too few have one."""
    x = F.log1p(size)
    rows = panel.withColumn("_x", F.when(F.col(size) > -1, x))
    day = Window.partitionBy("trade_date", F.col("_x").isNull())
    rank = F.rank().over(day.orderBy("_x")) + (F.count("*").over(Window.partitionBy("trade_date", "_x")) - 1) / F.lit(2.0)
    n = F.count("*").over(day)
    pct = rank / n
    # floor(pct * 5) computed as the quotient is, so that a percentile of exactly a fifth opens the next bucket
    bucket = F.when(F.col("_x").isNotNull() & (n >= least), F.least(F.floor(pct * 5), F.lit(4))).otherwise(-1)
    return rows.withColumn("bucket", bucket.cast("int")).drop("_x")


def size_metrics(cells: DataFrame) -> DataFrame:
    """(bucket, mean_rank_ic, std_rank_ic, positive_ratio) of cells (trade_date, bucket, f, fwd): daily correlation
    inside each size bucket; buckets without one have a positive ratio of 0."""
    spread = F.stddev_pop("f") * F.stddev_pop("fwd")
    ok = F.col("f").isNotNull() & F.col("fwd").isNotNull() & (F.col("bucket") >= 0)
    daily = cells.filter(ok).groupBy("bucket", "trade_date").agg(F.when((F.count("*") >= 10) & (spread > 0), F.covar_pop("f", "fwd") / spread).alias("ic"))
    stats = daily.filter("ic is not null").groupBy("bucket").agg(
        F.avg("ic").alias("mean_rank_ic"), F.stddev_pop("ic").alias("std_rank_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio")
    )
    names = F.array(*[F.lit(b) for b in BUCKETS])
    every = cells.sparkSession.range(len(BUCKETS)).select(F.col("id").cast("int").alias("bucket"), F.get(names, F.col("id").cast("int")).alias("name"))
    return every.join(stats, "bucket", "left").select(
        F.col("name").alias("bucket"), "mean_rank_ic", "std_rank_ic", F.coalesce("positive_ratio", F.lit(0.0)).alias("positive_ratio")
    )


def industry_map(rows: DataFrame) -> DataFrame:
    """(code, industry): the last known industry, UNKNOWN if there is none."""
    known = F.when(F.col("industry").isNotNull(), F.col("trade_date"))
    return rows.groupBy("code").agg(F.coalesce(F.max_by("industry", known), F.lit("UNKNOWN")).alias("industry"))


def industry_metrics(cells: DataFrame) -> DataFrame:
    """(industry, n_samples, positive_ratio, within_ic): samples with both values; the mean over dates of the
    correlation inside the industry is an addition of ours, positive_ratio is 0 as single points have no sign."""
    ok = cells.filter(F.col("f").isNotNull() & F.col("fwd").isNotNull())
    spread = F.stddev_pop("f") * F.stddev_pop("fwd")
    daily = ok.groupBy("industry", "trade_date").agg(F.count("*").alias("n"), F.when((F.count("*") >= 10) & (spread > 0), F.covar_pop("f", "fwd") / spread).alias("ic"))
    return daily.groupBy("industry").agg(F.sum("n").alias("n_samples"), F.lit(0.0).alias("positive_ratio"), F.avg("ic").alias("within_ic"))


def neutralise(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """rows with the value less its group mean, and its ratio to that mean."""
    mean = F.avg(value).over(Window.partitionBy(*by))
    return rows.withColumns({f"{value}_neutral": F.col(value) - mean, f"{value}_ratio": F.when(mean != 0, F.col(value) / mean)})


def overall_ranks(rows: DataFrame, values: list[str], tie: str, parts: int = 32) -> list[Column]:
    """For each of values the place of each row of a whole table by it, greatest first, NULLs last, ties in the order of tie.
    Rows are dealt to ``parts`` stretches of the value and ranked inside each; the sizes of the stretches before are added.
    One sketch and one count serve all values."""
    cuts = rows.approxQuantile(values, [i / parts for i in range(1, parts)], 0.005)

    def stretch(value: str, edges: list[float]) -> Column:
        held = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]).cast("array<double>")
        above = F.coalesce(F.size(F.filter(held, lambda e: e > F.col(value))), F.lit(parts + 1))
        return F.when(F.col(value).isNull(), parts + 1).otherwise(above)

    stretches = [stretch(v, c) for v, c in zip(values, cuts)]
    each = F.posexplode(F.array(*stretches)).alias("v", "s")
    sizes = rows.select(each).groupBy("v", "s").agg(F.count("*").alias("n")).collect()  # at most parts + 1 rows a value
    out = []
    for i, (value, at) in enumerate(zip(values, stretches)):
        before, total = [], 0
        for r in sorted(r for r in sizes if r.v == i):
            before += [F.lit(r.s), F.lit(total)]
            total += r.n
        place = F.row_number().over(Window.partitionBy(at).orderBy(F.desc_nulls_last(value), tie))
        out.append((place + (F.try_element_at(F.create_map(*before), at) if before else F.lit(0))).cast("long"))
    return out


def overall_rank(rows: DataFrame, value: str, tie: str, parts: int = 32) -> Column:
    """overall_ranks() by one value."""
    return overall_ranks(rows, [value], tie, parts)[0]
