"""Feature columns of a sparse daily table: one row per code and trade date, absent columns read as NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfactor.functions.missing import clean, safe_div

#: Features open to expressions, in the order in which templates enumerate them. Fixed values.
PUBLIC = """
ret_1d hl_range oc_ret close_pos gap_ret intraday_reversal amount_log vol_log turnover_log price_volume_pressure
amplitude_turnover volume_ratio_x_ret sm_net_ratio md_net_ratio lg_net_ratio main_net_ratio retail_pressure
big_vs_small_flow flow_imbalance large_order_intensity active_big_buy_pressure chip_width_90 chip_width_70
chip_cost_bias chip_median_bias chip_upper_pressure chip_lower_support winner_rate_norm hist_price_position
winner_cost_divergence
""".split()
OTHER = "upper_shadow lower_shadow amount_per_vol size_log free_turnover_gap liquidity_crowding".split()

_INPUTS = """
open high low close pre_close vol amount buy_sm_amount sell_sm_amount buy_md_amount sell_md_amount buy_lg_amount
sell_lg_amount net_mf_amount his_low his_high cost_5pct cost_15pct cost_50pct cost_85pct cost_95pct weight_avg
winner_rate turnover_rate turnover_rate_f volume_ratio circ_mv
""".split()


def _price(c) -> dict[str, Column]:
    body = c("close") - c("open")
    return {
        "hl_range": safe_div(c("high") - c("low"), c("pre_close")),
        "oc_ret": safe_div(body, c("open")),
        "upper_shadow": safe_div(c("high") - F.greatest(c("open"), c("close")), c("pre_close")),
        "lower_shadow": safe_div(F.least(c("open"), c("close")) - c("low"), c("pre_close")),
        "close_pos": safe_div(c("close") - c("low"), c("high") - c("low")),
        "gap_ret": safe_div(c("open") - c("pre_close"), c("pre_close")),
        "intraday_reversal": -safe_div(body, c("high") - c("low")),
        "amount_log": F.log1p(c("amount")),
        "vol_log": F.log1p(c("vol")),
        "turnover_log": F.log1p(c("turnover_rate")),
        "amount_per_vol": safe_div(c("amount"), c("vol")),
        "size_log": F.log1p(c("circ_mv")),
        "free_turnover_gap": c("turnover_rate_f") - c("turnover_rate"),
    }


def _flow(c) -> dict[str, Column]:
    buy = {s: c(f"buy_{s}_amount") for s in ("sm", "md", "lg")}
    sell = {s: c(f"sell_{s}_amount") for s in ("sm", "md", "lg")}
    net = {s: safe_div(buy[s] - sell[s], buy[s] + sell[s]) for s in buy}
    big_buy, big_sell = buy["md"] + buy["lg"], sell["md"] + sell["lg"]
    return {
        "sm_net_ratio": net["sm"],
        "md_net_ratio": net["md"],
        "lg_net_ratio": net["lg"],
        "main_net_ratio": safe_div(big_buy - big_sell, big_buy + big_sell),
        "retail_pressure": -net["sm"],
        "big_vs_small_flow": net["lg"] - net["sm"],
        "flow_imbalance": safe_div(c("net_mf_amount"), c("amount")),
        "large_order_intensity": safe_div(buy["lg"] + sell["lg"], buy["sm"] + sell["sm"] + big_buy + big_sell),
        "active_big_buy_pressure": safe_div(buy["lg"], buy["lg"] + sell["lg"]) - 0.5,
    }


def _chip(c) -> dict[str, Column]:
    bias = safe_div(c("close") - c("weight_avg"), c("weight_avg"))
    return {
        "chip_width_90": safe_div(c("cost_95pct") - c("cost_5pct"), c("cost_50pct")),
        "chip_width_70": safe_div(c("cost_85pct") - c("cost_15pct"), c("cost_50pct")),
        "chip_cost_bias": bias,
        "chip_median_bias": safe_div(c("close") - c("cost_50pct"), c("cost_50pct")),
        "chip_upper_pressure": safe_div(c("cost_95pct") - c("close"), c("close")),
        "chip_lower_support": safe_div(c("close") - c("cost_5pct"), c("close")),
        "winner_rate_norm": c("winner_rate") / 100.0,
        "hist_price_position": safe_div(c("close") - c("his_low"), c("his_high") - c("his_low")),
        "winner_cost_divergence": c("winner_rate") / 100.0 - bias,
    }


def with_features(rows: DataFrame, code: str = "code", date: str = "trade_date") -> DataFrame:
    """rows with all features. ret_1d is taken over a code's own consecutive rows, missing closes filled forward;
    everything else is local to the row."""
    absent = {x: F.lit(None).cast("double") for x in _INPUTS if x not in rows.columns}
    rows = rows.withColumns(absent) if absent else rows
    own = Window.partitionBy(code).orderBy(date)
    filled = rows.withColumn("_close", F.last("close", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    local = _price(F.col) | _flow(F.col) | _chip(F.col)
    ret = F.when(F.lag("_close").over(own) != 0, F.col("_close") / F.lag("_close").over(own) - 1)
    out = filled.withColumns({**local, "ret_1d": ret}).drop("_close")
    products = {
        "price_volume_pressure": F.col("ret_1d") * F.col("vol_log"),
        "amplitude_turnover": F.col("hl_range") * F.col("turnover_log"),
        "volume_ratio_x_ret": F.col("volume_ratio") * F.col("ret_1d"),
        "liquidity_crowding": F.col("turnover_log") * F.col("volume_ratio"),
    }
    out = out.withColumns(products)
    return out.withColumns({f: clean(F.col(f)) for f in PUBLIC})
