"""The registered queries of the factor engine and the SQL that DuckDB runs for the same result."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfactor.functions.features import OTHER, PUBLIC, with_features
from loomfactor.operators import backtest, diagnostics, groups, metrics
from loomfactor.operators.panel import densify, forward_return
from loomfactor.plans import mining, validation
from loomfactor.plans.compile import evaluate, long_form
from loomfactor.plans.expressions import Call, Expr, canonical, parse
from loomfactor.plans.grammar import enumerate_templates
from loomfactor.sources import adapters, files, panels, store, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

W = 10
X, Y = "ret_1d", "vol_log"
#: Days split for training and test figures, and the least values of a usable day at any scale of the test data.
TRAIN_END, TEST_START, LEAST = "19961231", "19970101", 10


#: Single divisions, equal to the last bit on both sides, and a quotient of sums whose sixth decimal can tie.
EXACT, FINE = {"close"}, {"amount_per_vol": 9, "m1": 2, "m2": 2}


def rounded(df: DataFrame) -> DataFrame:
    kept = [F.col(c) if t != "double" or c in EXACT else (F.round(c, FINE.get(c, 6)) + F.lit(0.0)).alias(c) for c, t in df.dtypes]
    return df.select(*kept)


def _q(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---- panels ------------------------------------------------------------------------------------------------------


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(adapters.bars(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str, fields=(X, Y, "close", "circ_mv")) -> DataFrame:
    return densify(features(spark, sf_dir), list(fields))


def scored(spark: SparkSession, sf_dir: str, expr: str = f"Rank(TsMean(${X},{W}))") -> DataFrame:
    """Long frame of one expression with forward returns."""
    base = panel(spark, sf_dir).withColumn("fwd", forward_return(5))
    return long_form(evaluate(base, {"e": parse(expr)}, ["fwd", "circ_mv", "close"]), ["e"], ["fwd", "circ_mv", "close"])


BARS = """
items as (
  select cast(l_suppkey as varchar) as code, strftime(date_trunc('month', l_shipdate), '%Y%m%d') as trade_date,
    l_extendedprice / l_quantity as price, l_quantity as qty, l_extendedprice as ext, l_linestatus as side,
    l_shipdate as o1, l_orderkey as o2, l_linenumber as o3, l_partkey as o4
  from lineitem
), agg as (
  select code, trade_date, first(price order by o1, o2, o3, o4) as open, last(price order by o1, o2, o3, o4) as close,
    max(price) as high, min(price) as low, sum(qty) as vol, sum(ext) as amount, sum(price * qty) / sum(qty) as weight_avg,
    quantile_cont(price, 0.05) as cost_5pct, quantile_cont(price, 0.15) as cost_15pct, quantile_cont(price, 0.5) as cost_50pct,
    quantile_cont(price, 0.85) as cost_85pct, quantile_cont(price, 0.95) as cost_95pct,
    sum(case when qty <= 10 and side = 'O' then ext else 0 end) as bsm, sum(case when qty <= 10 and side = 'F' then ext else 0 end) as ssm,
    sum(case when qty > 10 and qty <= 30 and side = 'O' then ext else 0 end) as bmd,
    sum(case when qty > 10 and qty <= 30 and side = 'F' then ext else 0 end) as smd,
    sum(case when qty > 30 and side = 'O' then ext else 0 end) as blg, sum(case when qty > 30 and side = 'F' then ext else 0 end) as slg
  from items group by all
), bars as (
  select *, lag(close) over w as pre_close, bmd + blg - smd - slg as net_mf,
    min(low) over (w rows unbounded preceding) as his_low, max(high) over (w rows unbounded preceding) as his_high,
    case when high > low then 100 * (close - low) / (high - low) end as winner_rate, vol / 100 as turnover_rate, vol / 80 as turnover_rate_f,
    vol / avg(vol) over (w rows between 4 preceding and current row) as volume_ratio,
    sum(amount) over (w rows unbounded preceding) as circ_mv
  from agg window w as (partition by code order by trade_date)
), feat as (
  select *, close / pre_close - 1 as ret_1d, ln(1 + vol) as vol_log from bars
)"""
PANEL = BARS + """, cal as (
  select trade_date, row_number() over (order by trade_date) as t from (select distinct trade_date from feat)
), p as (
  select c.t, c.trade_date, k.code, f.ret_1d as x, f.vol_log as y, f.close, f.circ_mv
  from cal c cross join (select distinct code from feat) k left join feat f using (trade_date, code)
)"""
SCORED = PANEL + f""", e1 as (
  select *, case when count(x) over w = {W} then avg(x) over w end as m, lead(close, 5) over (partition by code order by t) / close - 1 as fwd
  from p window w as (partition by code order by t rows between {W - 1} preceding and current row)
), e as (
  select t, trade_date, code, fwd, circ_mv, close,
    case when m is not null then row_number() over (partition by trade_date, m is null order by m, code)
      / count(*) over (partition by trade_date, m is null) end as f
  from e1
)"""
DAILY = SCORED + """, prs as (
  select *, row_number() over (partition by t order by f, code) as rf, row_number() over (partition by t order by fwd, code) as rr,
    rank() over (partition by t order by f) + (count(*) over (partition by t, f) - 1) / 2.0 as af,
    rank() over (partition by t order by fwd) + (count(*) over (partition by t, fwd) - 1) / 2.0 as ar
  from e where f is not null and fwd is not null
), d0 as (
  select t, trade_date, count(*) as n, stddev_pop(f) * stddev_pop(fwd) as s, covar_pop(f, fwd) as c,
    stddev_pop(rf) * stddev_pop(rr) as rs, covar_pop(rf, rr) as rc, stddev_pop(af) * stddev_pop(ar) as vs, covar_pop(af, ar) as vc
  from prs group by all
), d as (
  select t, trade_date, case when n >= 10 and n * s > 1e-10 then c / s end as ic, case when n >= 10 and n * rs > 1e-10 then rc / rs end as rank_ic,
    case when n >= 10 and s > 0 then c / s end as vic, case when n >= 10 and vs > 0 then vc / vs end as vrank_ic
  from d0
)""" + f""", u as (
  select t, trade_date, row_number() over (order by t) as u from (select t, trade_date, count(f) as n from e group by all) where n >= {LEAST}
), j as (
  select u.t, u.trade_date, u.u, ic, rank_ic, vic, vrank_ic from u left join d using (t, trade_date)
)"""

# ---- sources -----------------------------------------------------------------------------------------------------


@_q("entry_rank", f"with {SCORED} select t, trade_date, code, round(f, 6) + 0.0::DOUBLE as f, round(fwd, 6) + 0.0::DOUBLE as fwd from e")
def _entry(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("t", "trade_date", "code", "f", "fwd"))


@_q(
    "src_join5",
    f"""with {BARS}, snap as (
  select cast(s_suppkey as varchar) as code, r_name as industry from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
) select code, trade_date, close, round(bsm, 6) as buy_sm_amount, round(cost_50pct, 6) as cost_50pct,
  round(circ_mv, 6) as circ_mv, industry from feat left join snap using (code)
  where trade_date between '19930101' and '19951231' and close > 1000""",
)
def _src_join5(spark, sf_dir):
    rows = adapters.bars(spark, sf_dir)
    keys = ["code", "trade_date"]
    daily = rows.select(*keys, "close")
    others = [rows.select(*keys, c) for c in ("buy_sm_amount", "cost_50pct", "circ_mv")]
    snap = adapters.snapshot(spark, sf_dir).drop("name")
    return rounded(tables.market(daily, others, snap, "19930101", "19951231", min_price=1000.0).select(*keys, "close", "buy_sm_amount", "cost_50pct", "circ_mv", "industry"))


@_q("pool_semi", f"with {BARS} select code, trade_date, close from feat where code in (select cast(s_suppkey as varchar) from supplier where s_acctbal > 0)")
def _pool_semi(spark, sf_dir):
    pool = adapters.read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("code"))
    return rounded(adapters.bars(spark, sf_dir).join(pool.distinct(), "code", "left_semi").select("code", "trade_date", "close"))


@_q("densify", f"with {PANEL} select t, trade_date, code, round(x, 6) + 0.0::DOUBLE as ret_1d, close from p")
def _densify(spark, sf_dir):
    return rounded(panel(spark, sf_dir).select(F.col("t").cast("long").alias("t"), "trade_date", "code", "ret_1d", "close"))


@_q(
    "densify_events",
    """with a as (select cast(user_id as varchar) as code, strftime(ts, '%Y%m%d') as trade_date, avg(value) as close from events group by all)
select c.trade_date, k.code, round(a.close, 6) as mean_value from (select distinct trade_date from a) c cross join (select distinct code from a) k
left join a using (trade_date, code)""",
)
def _densify_events(spark, sf_dir):
    return rounded(densify(adapters.events(spark, sf_dir), ["close"]).select("trade_date", "code", F.col("close").alias("mean_value")))


_DIV = lambda a, b: f"case when abs({b}) >= 1e-9 then ({a}) / ({b}) end"
FEATURE_SQL = {
    "ret_1d": "ret_1d",
    "hl_range": _DIV("high - low", "pre_close"),
    "oc_ret": _DIV("close - open", "open"),
    "upper_shadow": _DIV("high - greatest(open, close)", "pre_close"),
    "lower_shadow": _DIV("least(open, close) - low", "pre_close"),
    "close_pos": _DIV("close - low", "high - low"),
    "gap_ret": _DIV("open - pre_close", "pre_close"),
    "intraday_reversal": _DIV("open - close", "high - low"),
    "amount_log": "ln(1 + amount)",
    "vol_log": "vol_log",
    "turnover_log": "ln(1 + turnover_rate)",
    "amount_per_vol": _DIV("amount", "vol"),
    "price_volume_pressure": "ret_1d * vol_log",
    "amplitude_turnover": f"({_DIV('high - low', 'pre_close')}) * ln(1 + turnover_rate)",
    "volume_ratio_x_ret": "volume_ratio * ret_1d",
    "sm_net_ratio": _DIV("bsm - ssm", "bsm + ssm"),
    "md_net_ratio": _DIV("bmd - smd", "bmd + smd"),
    "lg_net_ratio": _DIV("blg - slg", "blg + slg"),
    "main_net_ratio": _DIV("bmd + blg - smd - slg", "bmd + blg + smd + slg"),
    "retail_pressure": "-" + _DIV("bsm - ssm", "bsm + ssm").replace("case", "(case", 1) + ")",
    "big_vs_small_flow": f"({_DIV('blg - slg', 'blg + slg')}) - ({_DIV('bsm - ssm', 'bsm + ssm')})",
    "flow_imbalance": _DIV("net_mf", "amount"),
    "large_order_intensity": _DIV("blg + slg", "bsm + ssm + bmd + smd + blg + slg"),
    "active_big_buy_pressure": f"({_DIV('blg', 'blg + slg')}) - 0.5",
    "chip_width_90": _DIV("cost_95pct - cost_5pct", "cost_50pct"),
    "chip_width_70": _DIV("cost_85pct - cost_15pct", "cost_50pct"),
    "chip_cost_bias": _DIV("close - weight_avg", "weight_avg"),
    "chip_median_bias": _DIV("close - cost_50pct", "cost_50pct"),
    "chip_upper_pressure": _DIV("cost_95pct - close", "close"),
    "chip_lower_support": _DIV("close - cost_5pct", "close"),
    "winner_rate_norm": "winner_rate / 100",
    "hist_price_position": _DIV("close - his_low", "his_high - his_low"),
    "winner_cost_divergence": f"winner_rate / 100 - ({_DIV('close - weight_avg', 'weight_avg')})",
    "size_log": "ln(1 + circ_mv)",
    "free_turnover_gap": "turnover_rate_f - turnover_rate",
    "liquidity_crowding": "ln(1 + turnover_rate) * volume_ratio",
}


def _feature_query(names, spark, sf_dir):
    return rounded(features(spark, sf_dir).select("code", "trade_date", *names))


for _group, _names in {
    "feat_price": [*PUBLIC[:12], *OTHER],
    "feat_flow": PUBLIC[12:21],
    "feat_chip": PUBLIC[21:],
}.items():
    _cols = ", ".join(f"round({FEATURE_SQL[n]}, {FINE.get(n, 6)}) + 0.0::DOUBLE as {n}" for n in _names)
    _q(_group, f"with {BARS} select code, trade_date, {_cols} from feat")(partial(_feature_query, _names))

# ---- operators of the expression language ------------------------------------------------------------------------

_FULL = lambda e: f"case when count(x) over w = {W} then {e} end"
_LIST = "list(x) over w"
_PX, _PY = "(case when y is not null then x end)", "(case when x is not null then y end)"
_LAG = f"lag(x, {W}) over o"
OP_SQL = {
    "Abs": ("Abs($x)", "abs(x)"),
    "SLog1p": ("SLog1p($x)", "sign(x) * ln(1 + abs(x))"),
    "Inv": ("Inv($x)", "case when abs(x) >= 1e-9 then 1 / x end"),
    "Sign": ("Sign($x)", "sign(x)::DOUBLE"),
    "Log": ("Log(Abs($x))", "case when abs(x) > 0 then ln(abs(x)) end"),
    "Rank": ("Rank($x)", "case when x is not null then row_number() over (partition by trade_date, x is null order by x, code) / count(*) over (partition by trade_date, x is null) end"),
    "Add": ("Add($x,$y)", "x + y"),
    "Sub": ("Sub($x,$y)", "x - y"),
    "Mul": ("Mul($x,$y)", "x * y"),
    "Div": ("Div($x,$y)", "case when abs(y) >= 1e-9 then x / y end"),
    "Pow": ("Pow($x,0.5)", "case when x >= 0 then sqrt(x) end"),
    "Greater": ("Greater($x,$y)", "case when x is not null and y is not null then greatest(x, y) end"),
    "Less": ("Less($x,$y)", "case when x is not null and y is not null then least(x, y) end"),
    "Ref": ("Ref($x,10)", _LAG),
    "TsMean": ("TsMean($x,10)", _FULL("avg(x) over w")),
    "TsSum": ("TsSum($x,10)", _FULL("sum(x) over w")),
    "TsStd": ("TsStd($x,10)", _FULL("stddev_pop(x) over w")),
    "TsVar": ("TsVar($x,10)", _FULL("var_pop(x) over w")),
    "TsMax": ("TsMax($x,10)", _FULL("max(x) over w")),
    "TsMin": ("TsMin($x,10)", _FULL("min(x) over w")),
    "TsMed": ("TsMed($x,10)", _FULL("median(x) over w")),
    "TsDelta": ("TsDelta($x,10)", f"x - {_LAG}"),
    "TsPctChange": ("TsPctChange($x,10)", f"case when abs({_LAG}) >= 1e-9 then (x - {_LAG}) / ({_LAG}) end"),
    "TsDiv": ("TsDiv($x,10)", _FULL("case when abs(avg(x) over w) >= 1e-9 then x / (avg(x) over w) end")),
    "TsIr": ("TsIr($x,10)", _FULL("case when stddev_pop(x) over w >= 1e-9 then (avg(x) over w) / (stddev_pop(x) over w) end")),
    "TsMinMaxDiff": ("TsMinMaxDiff($x,10)", _FULL("(max(x) over w) - (min(x) over w)")),
    "TsMaxDiff": ("TsMaxDiff($x,10)", _FULL("x - (max(x) over w)")),
    "TsMinDiff": ("TsMinDiff($x,10)", _FULL("x - (min(x) over w)")),
    "TsMad": ("TsMad($x,10)", "case when n = 10 then list_sum(list_transform(a, lambda v: abs(v - m))) / 10 end"),
    "TsSkew": ("TsSkew($x,10)", _FULL("coalesce(skewness(x) over w, 0)")),
    "TsKurt": ("TsKurt($x,10)", _FULL("coalesce(kurtosis(x) over w, -3)")),
    "TsRank": ("TsRank($x,10)", "case when n = 10 then (len(list_filter(a, lambda v: v < x)) + (len(list_filter(a, lambda v: v = x)) + 1) / 2.0) / 10 end"),
    "TsWMA": ("TsWMA($x,10)", _FULL("((sum(t * x) over w) - (t - 10) * (sum(x) over w)) / 55")),
    "TsCov": ("TsCov($x,$y,10)", f"case when count({_PX}) over w = 10 then covar_samp({_PX}, {_PY}) over w end"),
    "TsCorr": (
        "TsCorr($x,$y,10)",
        f"case when count({_PX}) over w >= 5 and t >= 10 and (count({_PX}) over w) * (stddev_pop({_PX}) over w) * (stddev_pop({_PY}) over w) > 1e-10 "
        f"then (covar_pop({_PX}, {_PY}) over w) / ((stddev_pop({_PX}) over w) * (stddev_pop({_PY}) over w)) end",
    ),
    "TsEMA": ("TsEMA($x,10)", "case when k >= 10 then exp(l) * s end"),
}
_EMA = """, g as (select *, case when x is not null then t - last_value(case when x is not null then t end ignore nulls)
    over (partition by code order by t rows between unbounded preceding and 1 preceding) end as gap from p
), h as (select *, case when x is not null then coalesce(ln(power(9.0 / 11, gap) / (power(9.0 / 11, gap) + 2.0 / 11)), 0) end as lp from g
), i as (select *, sum(lp) over (partition by code order by t rows unbounded preceding) as l from h
), q as (select *, count(x) over z as k, sum((case when gap is null then 1 else 1 - exp(lp) end) * x * exp(-l)) over z as s
  from i window z as (partition by code order by t rows unbounded preceding))"""


def _op_query(expr, spark, sf_dir):
    base = panel(spark, sf_dir, (X, Y)).withColumnsRenamed({X: "x", Y: "y"})
    return rounded(evaluate(base, {"v": parse(expr)}).select(F.col("t").cast("long").alias("t"), "code", "v"))


for _name, (_expr, _sql) in OP_SQL.items():
    _source, _more = "p", ""
    if _name == "TsEMA":
        _source, _more = "q", _EMA
    elif _name in ("TsMad", "TsRank"):
        _source = "q"
        _more = f", q as (select *, count(x) over w as n, avg(x) over w as m, {_LIST} as a from p window w as (partition by code order by t rows between {W - 1} preceding and current row))"
    _q(
        f"op_{_name.lower()}",
        f"with {PANEL}{_more} select t, code, round({_sql}, 6) + 0.0::DOUBLE as v from {_source} "
        f"window w as (partition by code order by t rows between {W - 1} preceding and current row), o as (partition by code order by t)",
    )(partial(_op_query, _expr))

# ---- metrics -----------------------------------------------------------------------------------------------------


@_q("fwd_ret", f"with {SCORED} select t, code, round(fwd, 6) + 0.0::DOUBLE as fwd from e")
def _fwd(spark, sf_dir):
    return rounded(panel(spark, sf_dir, ("close",)).select(F.col("t").cast("long").alias("t"), "code", forward_return(5).alias("fwd")))


@_q("daily_ic", f"with {DAILY} select t, trade_date, round(ic, 6) + 0.0::DOUBLE as ic from d")
def _daily_ic(spark, sf_dir):
    return rounded(metrics.daily_ic(scored(spark, sf_dir)).select("t", "trade_date", "ic"))


@_q("daily_rank_ic_ord", f"with {DAILY} select t, trade_date, round(rank_ic, 6) + 0.0::DOUBLE as rank_ic from d")
def _rank_ord(spark, sf_dir):
    return rounded(metrics.daily_ic(scored(spark, sf_dir)).select("t", "trade_date", "rank_ic"))


@_q("daily_ic_wide", f"with {DAILY} select t, trade_date, n as pairs, round(ic, 6) + 0.0::DOUBLE as ic, round(rank_ic, 6) + 0.0::DOUBLE as rank_ic from d join d0 using (t, trade_date)")
def _daily_wide(spark, sf_dir):
    """Scores by ranks that are sorted over many tasks."""
    days = metrics.daily_apart(scored(spark, sf_dir), files.shared_folder(spark)).filter("pairs > 0")
    return rounded(days.select("t", "trade_date", "pairs", "ic", "rank_ic"))


@_q("daily_rank_ic_avg", f"with {DAILY} select t, trade_date, round(vic, 6) + 0.0::DOUBLE as ic, round(vrank_ic, 6) + 0.0::DOUBLE as rank_ic from d")
def _rank_avg(spark, sf_dir):
    return rounded(metrics.daily_ic(scored(spark, sf_dir), "average").select("t", "trade_date", "ic", "rank_ic"))


_STATS = """count(*) as usable_days, avg(ic) as mean_ic, avg(ic) / nullif(stddev_pop(ic), 0) as icir, avg(rank_ic) as mean_rank_ic,
  avg(rank_ic) / nullif(stddev_pop(rank_ic), 0) as rank_icir, avg(case when rank_ic > 0 then 1.0 else 0.0 end) as pos"""


@_q(
    "factor_summary",
    f"""with {DAILY}, s as (select {_STATS} from j), c as (select count(f) / count(*) as coverage from e)
select round(coverage, 6) as coverage, usable_days, round(mean_ic, 6) as mean_ic, round(icir, 6) as icir, round(mean_rank_ic, 6) as mean_rank_ic,
  round(rank_icir, 6) as rank_icir, round(pos, 6)::DOUBLE as positive_rank_ic_ratio from s, c""",
)
def _summary(spark, sf_dir):
    cols = ["coverage", "usable_days", "mean_ic", "icir", "mean_rank_ic", "rank_icir", "positive_rank_ic_ratio"]
    return rounded(metrics.summary(scored(spark, sf_dir), LEAST).select(cols))


@_q(
    "train_test_score",
    f"""with {DAILY}, s as (
  select avg(case when trade_date <= '{TRAIN_END}' then rank_ic end) as a, avg(case when trade_date >= '{TEST_START}' then rank_ic end) as b,
    stddev_pop(case when trade_date <= '{TRAIN_END}' then rank_ic end) as sa, stddev_pop(case when trade_date >= '{TEST_START}' then rank_ic end) as sb from j
) select round(a, 6) as train_mean_rank_ic, round(a / nullif(sa, 0), 6) as train_rank_icir, round(b, 6) as test_mean_rank_ic,
  round(b / nullif(sb, 0), 6) as test_rank_icir, round(abs(b) * abs(b / nullif(sb, 0)) * case when a * b > 0 then 1 else 0.25 end, 6) as score
from s""",
)
def _train_test(spark, sf_dir):
    out = metrics.summary(scored(spark, sf_dir), LEAST, TRAIN_END, TEST_START)
    return rounded(out.select("train_mean_rank_ic", "train_rank_icir", "test_mean_rank_ic", "test_rank_icir", "score"))


@_q("year_rank_ic", f"with {DAILY} select substr(trade_date, 1, 4) as year, round(avg(rank_ic), 6) + 0.0::DOUBLE as rank_ic from j group by all")
def _year(spark, sf_dir):
    return rounded(metrics.year_rank_ic(scored(spark, sf_dir), LEAST).select("year", "rank_ic"))


@_q(
    "turnover_proxy",
    f"""with {DAILY}, k as (
  select e.code, u.u, row_number() over (partition by e.t order by f, code) / count(*) over (partition by e.t) as rk
  from e join u using (t) where f is not null
), m as (select *, lag(rk) over (partition by code order by u) as b, lag(u) over (partition by code order by u) as ub from k)
select round(avg(case when ub = u - 1 then abs(rk - b) end), 6) as turnover_proxy from m""",
)
def _turnover(spark, sf_dir):
    return rounded(metrics.turnover_proxy(scored(spark, sf_dir), LEAST).select("turnover_proxy"))


@_q(
    "quantile_spread",
    f"""with {DAILY}, k as (select t, fwd, rf / count(*) over (partition by t) as rk from prs), s as (
  select t, avg(case when rk >= 1 - 1 / 5.0::DOUBLE then fwd end) - avg(case when rk <= 1 / 5.0::DOUBLE then fwd end) as spread, count(*) as n from k group by t
) select round(avg(spread), 6) + 0.0::DOUBLE as quantile_spread from s where n >= 10 having count(*) > 0""",
)
def _spread(spark, sf_dir):
    return rounded(metrics.quantile_spread(scored(spark, sf_dir), least=LEAST).select("quantile_spread"))


_ROLL = ", ".join(
    f"round(case when rn > {w} and count(vrank_ic) over (order by t rows between {w} preceding and 1 preceding) >= {w // 2} "
    f"then avg(vrank_ic) over (order by t rows between {w} preceding and 1 preceding) end, 6) + 0.0::DOUBLE as rolling_{w}_rank_ic"
    for w in (20, 60)
)


@_q(
    "rolling_ic",
    f"""with {DAILY}, r as (select c.t, c.trade_date, vrank_ic, row_number() over (order by c.t) as rn from cal c left join d using (t, trade_date))
select t, trade_date, round(vrank_ic, 6) + 0.0::DOUBLE as rank_ic, {_ROLL} from r""",
)
def _rolling(spark, sf_dir):
    return rounded(metrics.rolling_ic(scored(spark, sf_dir), (20, 60)).drop("expr_id"))


# ---- groups ------------------------------------------------------------------------------------------------------

_BUCKET = SCORED + """, b0 as (
  select *, rank() over (partition by trade_date, circ_mv is null order by ln(1 + circ_mv)) + (count(*) over (partition by trade_date, ln(1 + circ_mv)) - 1) / 2.0::DOUBLE as r,
    count(*) over (partition by trade_date, circ_mv is null) as n from e
), b as (select *, case when circ_mv is not null and n >= 10 then least(floor(r / n * 5), 4) else -1 end::INTEGER as bucket from b0)"""


def _bucketed(spark, sf_dir):
    return groups.size_bucket(scored(spark, sf_dir), least=10)


@_q("size_bucket", f"with {_BUCKET} select trade_date, code, bucket from b")
def _size_bucket(spark, sf_dir):
    return _bucketed(spark, sf_dir).select("trade_date", "code", "bucket")


@_q(
    "size_metrics",
    f"""with {_BUCKET}, dd as (select bucket, trade_date, case when count(*) >= 10 and stddev_pop(f) * stddev_pop(fwd) > 0 then covar_pop(f, fwd) / (stddev_pop(f) * stddev_pop(fwd)) end as ic
  from b where bucket >= 0 and f is not null and fwd is not null group by all
), st as (select bucket, avg(ic) as m, stddev_pop(ic) as s, avg(case when ic > 0 then 1.0 else 0.0 end) as p from dd where ic is not null group by 1),
nm as (select unnest([0, 1, 2, 3, 4]) as bucket, unnest(['micro', 'small', 'mid', 'large', 'mega']) as name)
select name as bucket, round(m, 6) + 0.0::DOUBLE as mean_rank_ic, round(s, 6) as std_rank_ic, round(coalesce(p, 0), 6)::DOUBLE as positive_ratio from nm left join st using (bucket)""",
)
def _size_metrics(spark, sf_dir):
    return rounded(groups.size_metrics(_bucketed(spark, sf_dir)))


_SNAP = """snap as (select cast(s_suppkey as varchar) as code, s_name as name, r_name as industry
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


@_q(
    "industry_map_all",
    f"with {_SNAP} select cast(l_suppkey as varchar) as code, coalesce(max(industry), 'UNKNOWN') as industry from lineitem l left join snap s on s.code = cast(l_suppkey as varchar) group by 1",
)
def _industry_map_all(spark, sf_dir):
    """Every code's industry, from the whole snapshot."""
    rows = adapters.bars(spark, sf_dir).select("code", "trade_date").join(adapters.snapshot(spark, sf_dir), "code", "left")
    return groups.industry_map(rows)


@_q(
    "industry_nsamples",
    f"with {SCORED}, {_SNAP} select industry, count(*) as n_samples, 0.0::DOUBLE as positive_ratio from e join snap using (code) where f is not null and fwd is not null group by 1",
)
def _industry_n(spark, sf_dir):
    cells = scored(spark, sf_dir).join(adapters.snapshot(spark, sf_dir), "code")
    return groups.industry_metrics(cells).select("industry", "n_samples", "positive_ratio")


# ---- portfolio ---------------------------------------------------------------------------------------------------

_WEIGHTS = SCORED + """, w0 as (
  select *, count(f) over (partition by t) as n, row_number() over (partition by t, f is null order by f desc, code) as place from e
), w1 as (
  select *, case when (t - 1) % 5 = 0 and n > 0 then case when f is not null and place <= greatest(1, floor(n * 0.1)) then 1 / greatest(1, floor(n * 0.1)) else 0 end end as fresh from w0
), w as (
  select *, coalesce(last_value(fresh ignore nulls) over (partition by code order by t rows unbounded preceding), 0) as w from w1
), r0 as (
  select t, lead(trade_date) over o as d, coalesce(w * (lead(close) over o / close - 1), 0) as g, abs(lead(w) over o - w) as c from w window o as (partition by code order by t)
), r as (
  select t, d as trade_date, sum(g) as gross, sum(c) as turnover, sum(g) - sum(c) * 15 / 1e4 as net from r0 where d is not null group by 1, 2
), eq as (select *, exp(sum(ln(1 + net)) over (order by t)) as equity from r)"""


def _weights(spark, sf_dir):
    return backtest.top_weights(scored(spark, sf_dir).select("t", "trade_date", "code", "f", "close"), 0.1)


@_q("top_weights", f"with {_WEIGHTS} select t, code, round(w, 6)::DOUBLE as w from w where w > 0")
def _top_weights(spark, sf_dir):
    return rounded(_weights(spark, sf_dir).filter("w > 0").select(F.col("t").cast("long").alias("t"), "code", "w"))


@_q("port_returns", f"with {_WEIGHTS} select trade_date, round(gross, 6) + 0.0::DOUBLE as gross, round(turnover, 6) as turnover, round(net, 6) + 0.0::DOUBLE as net from r")
def _port_returns(spark, sf_dir):
    return rounded(backtest.returns(_weights(spark, sf_dir)).select("trade_date", "gross", "turnover", "net"))


@_q("equity_curve", f"with {_WEIGHTS} select trade_date, round(ln(equity), 6) as log_equity from eq")
def _equity(spark, sf_dir):
    return rounded(backtest.equity(backtest.returns(_weights(spark, sf_dir))).select("trade_date", F.ln("equity").alias("log_equity")))


@_q(
    "port_stats",
    f"""with {_WEIGHTS}, pk as (select *, greatest(max(equity) over (order by t), 1) as peak,
  case when trade_date <= '{TRAIN_END}' then net end as a, case when trade_date >= '{TEST_START}' then net end as b from eq),
s as (select arg_max(equity, t) - 1 as tr, min(equity / peak - 1) as dd, avg(case when net > 0 then 1.0 else 0.0 end) as wr, avg(a) * 252 as ar,
  stddev_pop(a) * sqrt(252) as av, avg(b) * 252 as br, stddev_pop(b) * sqrt(252) as bv, avg(turnover) as turn from pk)
select round(ln(1 + tr), 6) as log_total_return, round(dd, 6) as max_drawdown, round(wr, 6)::DOUBLE as win_rate, round(ar, 6) as ann_return, round(av, 6) as ann_vol,
  round(ar / av, 6) as sharpe, round(br, 6) as test_ann_return, round(br / bv, 6) as test_sharpe, round(turn, 6) as avg_turnover, round(ar / -dd, 6) as calmar from s""",
)
def _port_stats(spark, sf_dir):
    out = backtest.stats(backtest.returns(_weights(spark, sf_dir)), TRAIN_END, TEST_START)
    return rounded(out.withColumn("log_total_return", F.log1p("total_return")).drop("total_return"))


@_q(
    "clean_factor",
    f"""with {SCORED}, k as (select trade_date, t, code, f, lead(close, 1) over o / close - 1 as p1, lead(close, 5) over o / close - 1 as p5, lead(close, 10) over o / close - 1 as p10
  from e window o as (partition by code order by t)), c as (select * from k where f is not null and p1 is not null and p5 is not null and p10 is not null),
q as (select trade_date, quantile_cont(f, [0.2, 0.4, 0.6, 0.8]) as edges from c group by 1)
select trade_date, code, round(f, 6) as factor, round(p1, 6) + 0.0::DOUBLE as period_1, round(p5, 6) + 0.0::DOUBLE as period_5, round(p10, 6) + 0.0::DOUBLE as period_10,
  (1 + len(list_filter(edges, lambda v: f > v)))::INTEGER as factor_quantile from c join q using (trade_date)""",
)
def _clean_factor(spark, sf_dir):
    return rounded(diagnostics.clean_factor(scored(spark, sf_dir)))


# ---- results and templates ---------------------------------------------------------------------------------------


@_q("topk_results", f"with {BARS} select code, round(sum(amount), 4) as score from feat group by 1 order by 2 desc nulls last, 1 limit 50")
def _topk(spark, sf_dir):
    rows = adapters.bars(spark, sf_dir).groupBy("code").agg(F.round(F.sum("amount"), 4).alias("score"))
    return store.top_k(rows.withColumn("canonical", F.col("code")), 50).drop("canonical")


@_q("resume_anti", "select cast(p_partkey as varchar) as canonical from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def _resume(spark, sf_dir):
    done = adapters.read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("canonical"))
    wanted = adapters.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("canonical"))
    return wanted.join(done.distinct(), "canonical", "left_anti")


# ---- warehouse queries -------------------------------------------------------------------------------------------

_DAYS = "days as (select user_id, date_trunc('day', ts) as day, last(value order by ts, event_id) as close, first(value order by ts, event_id) as open, max(value) as high, min(value) as low, count(*)::DOUBLE as vol from events group by all)"


def _event_days(spark, sf_dir) -> DataFrame:
    order = F.struct("ts", "event_id")
    return (
        adapters.read(spark, sf_dir, "events")
        .groupBy("user_id", F.date_trunc("day", "ts").alias("day"))
        .agg(F.max_by("value", order).alias("close"), F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").cast("double").alias("vol"))
    )


@_q(
    "d_weekly_bars",
    f"with {_DAYS} select user_id, strftime(date_trunc('week', day), '%Y%m%d') as week, first(open order by day) as open, last(close order by day) as close, max(high) as high, min(low) as low, sum(vol) as vol, count(*) as n from days group by 1, 2",
)
def _weekly(spark, sf_dir):
    week = F.date_format(F.date_trunc("week", "day"), "yyyyMMdd").alias("week")
    return (
        _event_days(spark, sf_dir).groupBy("user_id", week).agg(F.min_by("open", "day").alias("open"), F.max_by("close", "day").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("vol").alias("vol"), F.count("*").alias("n"))
    )


@_q("d_ma20", f"with {_DAYS} select user_id, strftime(day, '%Y%m%d') as day, round(avg(close) over (partition by user_id order by day rows between 19 preceding and current row), 6) + 0.0::DOUBLE as ma20 from days")
def _ma20(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(-19, 0)
    return rounded(_event_days(spark, sf_dir).select("user_id", F.date_format("day", "yyyyMMdd").alias("day"), F.avg("close").over(w).alias("ma20")))


@_q(
    "d_multi_horizon_ret",
    f"with {BARS} select code, trade_date, " + ", ".join(f"round(close / lag(close, {h}) over o - 1, 6) + 0.0::DOUBLE as ret_{h}" for h in (1, 5, 20)) + ", round(vol / nullif(avg(vol) over (partition by code order by trade_date rows between 19 preceding and current row), 0), 6) as vol_ratio from feat window o as (partition by code order by trade_date)",
)
def _horizons(spark, sf_dir):
    own = Window.partitionBy("code").orderBy("trade_date")
    rets = [(F.col("close") / F.lag("close", h).over(own) - 1).alias(f"ret_{h}") for h in (1, 5, 20)]
    ratio = F.col("vol") / F.nullif(F.avg("vol").over(own.rowsBetween(-19, 0)), F.lit(0.0))
    return rounded(adapters.bars(spark, sf_dir).select("code", "trade_date", *rets, ratio.alias("vol_ratio")))


@_q(
    "d_composite",
    f"""with {BARS}, m as (select code, sum(net_mf) / nullif(sum(amount), 0) as flow, avg(volume_ratio) as vr, max(circ_mv) as mv from feat group by 1), {_SNAP},
s as (select m.code, coalesce(industry, 'UNKNOWN') as industry, coalesce(flow, 0) as flow, least(vr, 2) as vr, mv, 0.5 * coalesce(flow, 0) + 0.5 * least(vr, 2) as score from m left join snap using (code))
select code, industry, round(score, 6) + 0.0::DOUBLE as score, row_number() over (order by flow desc, code) as flow_rank, row_number() over (order by vr desc, code) as vr_rank,
  row_number() over (order by mv desc, code) as mv_rank, row_number() over (partition by industry order by score desc, code) as industry_rank from s""",
)
def _composite(spark, sf_dir):
    m = adapters.bars(spark, sf_dir).groupBy("code").agg((F.sum("net_mf_amount") / F.nullif(F.sum("amount"), F.lit(0.0))).alias("flow"), F.avg("volume_ratio").alias("vr"), F.max("circ_mv").alias("mv"))
    s = m.join(adapters.snapshot(spark, sf_dir), "code", "left").select("code", F.coalesce("industry", F.lit("UNKNOWN")).alias("industry"), F.coalesce("flow", F.lit(0.0)).alias("flow"), F.least("vr", F.lit(2.0)).alias("vr"), "mv")
    path = files.shared_folder(spark)
    s.withColumn("score", 0.5 * F.col("flow") + 0.5 * F.col("vr")).write.parquet(path)  # a row a code, read by every ranking
    s, by = spark.read.parquet(path), ["flow", "vr", "mv"]
    places = [c.alias(f"{name}_rank") for name, c in zip(by, groups.overall_ranks(s, by, "code"))]
    inside = F.row_number().over(Window.partitionBy("industry").orderBy(F.desc("score"), "code")).cast("long").alias("industry_rank")
    return rounded(s.select("code", "industry", "score", *places, inside))


@_q("d_neutralize", f"with {BARS}, {_SNAP} select code, trade_date, round(vol - avg(vol) over g, 6) + 0.0::DOUBLE as vol_neutral, round(vol / nullif(avg(vol) over g, 0), 6) as vol_ratio from feat join snap using (code) window g as (partition by trade_date, industry)")
def _neutral(spark, sf_dir):
    rows = adapters.bars(spark, sf_dir).join(adapters.snapshot(spark, sf_dir), "code")
    return rounded(groups.neutralise(rows, "vol", ["trade_date", "industry"]).select("code", "trade_date", "vol_neutral", "vol_ratio"))


@_q("d_dup_check", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def _dups(spark, sf_dir):
    return adapters.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@_q("d_latest", f"with {BARS} select code, trade_date, close from feat where trade_date = (select max(trade_date) from feat) and code in ('1', '2', '3', '4', '5')")
def _latest(spark, sf_dir):
    rows = adapters.bars(spark, sf_dir)
    last = rows.agg(F.max("trade_date").alias("trade_date"))
    return rounded(rows.filter(F.col("code").isin("1", "2", "3", "4", "5")).join(F.broadcast(last), "trade_date").select("code", "trade_date", "close"))


@_q("d_industry_agg", f"with {BARS}, {_SNAP} select trade_date, industry, count(*) as n, round(avg(vol), 6) as avg_vol, round(avg(close), 6) as avg_close, round(avg(amount), 4) as avg_amount from feat join snap using (code) group by 1, 2")
def _industry_agg(spark, sf_dir):
    rows = adapters.bars(spark, sf_dir).join(adapters.snapshot(spark, sf_dir), "code").groupBy("trade_date", "industry")
    return rounded(rows.agg(F.count("*").alias("n"), F.avg("vol").alias("avg_vol"), F.avg("close").alias("avg_close"), F.round(F.avg("amount"), 4).alias("avg_amount")))


@_q("d_top50", f"with {BARS}, g as (select *, row_number() over (partition by trade_date order by amount desc, code) as rn from feat where exists (select 1 from supplier s where cast(s_suppkey as varchar) = code and s_acctbal <= close)) select trade_date, code, rn from g where rn <= 50")
def _top50(spark, sf_dir):
    rows, s = adapters.bars(spark, sf_dir), adapters.read(spark, sf_dir, "supplier")
    listed = rows.join(s, (F.col("s_suppkey").cast("string") == F.col("code")) & (F.col("s_acctbal") <= F.col("close")), "left_semi")
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("amount"), "code")).cast("long")
    return listed.select("trade_date", "code", place.alias("rn")).filter("rn <= 50")


@_q("d_filter_top", f"with {BARS} select code, trade_date, close, round(ret_1d, 6) + 0.0::DOUBLE as ret_1d from feat where trade_date >= '19970101' and close > 1500 and ret_1d is not null order by ret_1d desc, code, trade_date limit 10")
def _filter_top(spark, sf_dir):
    rows = features(spark, sf_dir).filter("trade_date >= '19970101' and close > 1500 and ret_1d is not null")
    return rounded(rows.orderBy(F.desc("ret_1d"), "code", "trade_date").limit(10).select("code", "trade_date", "close", "ret_1d"))


@_q("d_industry_day", f"with {BARS}, {_SNAP} select code, name, industry, close, trade_date from feat join snap using (code) where trade_date = '19960301' and industry = 'ASIA'")
def _industry_day(spark, sf_dir):
    rows = adapters.bars(spark, sf_dir).filter("trade_date = '19960301'")
    return rounded(rows.join(F.broadcast(adapters.snapshot(spark, sf_dir).filter("industry = 'ASIA'")), "code").select("code", "name", "industry", "close", "trade_date"))


@_q("d_kline_day", f"with {BARS} select trade_date, open, high, low, close, vol, round(amount, 4) as amount from feat where code = '1' and trade_date between '19940101' and '19961231'")
def _kline_day(spark, sf_dir):
    rows = adapters.bars(spark, sf_dir).filter("code = '1' and trade_date between '19940101' and '19961231'")
    return rows.select("trade_date", "open", "high", "low", "close", "vol", F.round("amount", 4).alias("amount"))


@_q(
    "d_kline_hour",
    """select user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as trade_time, first(value order by ts, event_id) as open, max(value) as high, min(value) as low,
  last(value order by ts, event_id) as close, count(*)::DOUBLE as vol from events
where user_id = (select min(user_id) from events) and hour(ts) between 9 and 15 group by 1, 2""",
)
def _kline_hour(spark, sf_dir):
    rows, order = adapters.read(spark, sf_dir, "events"), F.struct("ts", "event_id")
    first = rows.agg(F.min("user_id").alias("user_id"))
    rows = rows.filter(F.hour("ts").between(9, 15)).join(F.broadcast(first), "user_id", "left_semi")
    bars = rows.groupBy("user_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("trade_time"))
    return bars.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("vol"))


@_q(
    "d_adhoc_factors",
    f"""with {BARS}, m as (select code, trade_date, close, close / lag(close, 20) over (partition by code order by trade_date) - 1 as mom_20, net_mf / nullif(amount, 0) as flow from feat)
select code, trade_date, close, round(mom_20, 6) + 0.0::DOUBLE as mom_20, round(flow, 6) + 0.0::DOUBLE as flow from m where trade_date = '19961001' and code in ('1', '2', '3', '5', '8')""",
)
def _adhoc(spark, sf_dir):
    """The window comes before the filter on the date: after it there would be nothing to lag."""
    rows = adapters.bars(spark, sf_dir).filter(F.col("code").isin("1", "2", "3", "5", "8"))
    own = Window.partitionBy("code").orderBy("trade_date")
    cols = {"mom_20": F.col("close") / F.lag("close", 20).over(own) - 1, "flow": F.col("net_mf_amount") / F.nullif("amount", F.lit(0.0))}
    return rounded(rows.withColumns(cols).filter("trade_date = '19961001'").select("code", "trade_date", "close", "mom_20", "flow"))


# ---- long panels, groups that change, keys -----------------------------------------------------------------------


@_q(
    "const_keys",
    f"with {PANEL} select t, code, round(y * 1234567, 2) as m1, round(y * 1234568, 2) as m2, round(case when y is not null then greatest(y, 3.1234567::DOUBLE) end, 6) as m3, "
    "round(case when y is not null then greatest(y, 3.1234576::DOUBLE) end, 6) as m4 from p",
)
def _const_keys(spark, sf_dir):
    base = panel(spark, sf_dir, (Y,)).withColumnRenamed(Y, "y")
    exprs = {"m1": "Mul($y,1234567)", "m2": "Mul($y,1234568)", "m3": "Greater($y,3.1234567)", "m4": "Greater($y,3.1234576)"}
    out = evaluate(base, {k: parse(e) for k, e in exprs.items()})
    return rounded(out.select(F.col("t").cast("long").alias("t"), "code", *exprs))


@_q(
    "rolling_ic_120",
    """with d as (
  select p_brand as code, datediff('day', date '1990-01-01', l_shipdate::date)::INTEGER as t, avg(l_quantity) as f, avg(l_linenumber) as fwd from lineitem join part on l_partkey = p_partkey group by 1, 2
), k as (
  select t, rank() over (partition by t order by f) + (count(*) over (partition by t, f) - 1) / 2.0 as a, rank() over (partition by t order by fwd) + (count(*) over (partition by t, fwd) - 1) / 2.0 as b from d
), c as (select t, case when count(*) >= 10 and stddev_pop(a) * stddev_pop(b) > 0 then covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) end as ic from k group by t)
select t, round(ic, 6) + 0.0::DOUBLE as rank_ic, round(case when row_number() over (order by t) > 120 and count(ic) over z >= 60 then avg(ic) over z end, 6) + 0.0::DOUBLE as rolling_120_rank_ic
from c window z as (order by t rows between 120 preceding and 1 preceding)""",
)
def _rolling_120(spark, sf_dir):
    part = adapters.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("code"))
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    rows = adapters.read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    long = rows.groupBy("code", day.alias("t")).agg(F.avg("l_quantity").alias("f"), F.avg("l_linenumber").alias("fwd"))
    long = long.withColumns({"expr_id": F.lit("quantity"), "trade_date": F.col("t").cast("string")})
    return rounded(metrics.rolling_ic(long, (120,)).select("t", "rank_ic", "rolling_120_rank_ic"))


@_q(
    "industry_last",
    """with r as (select cast(l_suppkey as varchar) as code, strftime(date_trunc('month', l_shipdate), '%Y%m%d') as d, max(case when l_quantity > 48 then l_returnflag || l_linestatus end) as industry from lineitem group by 1, 2)
select code, coalesce(arg_max(industry, d) filter (industry is not null), 'UNKNOWN') as industry from r group by 1""",
)
def _industry_last(spark, sf_dir):
    """Industries that change over time and are often missing: the last known one counts."""
    month = F.date_format(F.date_trunc("month", "l_shipdate"), "yyyyMMdd").alias("trade_date")
    told = F.max(F.when(F.col("l_quantity") > 48, F.concat("l_returnflag", "l_linestatus"))).alias("industry")
    return groups.industry_map(adapters.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("code"), month).agg(told))


@_q(
    "ic_by_period",
    f"""with {SCORED}, k as (select trade_date, code, f, lead(close, 1) over o / close - 1 as period_1, lead(close, 5) over o / close - 1 as period_5, lead(close, 10) over o / close - 1 as period_10
  from e window o as (partition by code order by t)), c as (select * from k where f is not null and period_1 is not null and period_5 is not null and period_10 is not null),
l as (unpivot c on period_1, period_5, period_10 into name period value r), x as (
  select trade_date, period, rank() over (partition by trade_date, period order by f) + (count(*) over (partition by trade_date, period, f) - 1) / 2.0 as a,
    rank() over (partition by trade_date, period order by r) + (count(*) over (partition by trade_date, period, r) - 1) / 2.0 as b from l)
select trade_date, period, round(case when count(*) >= 10 and stddev_pop(a) * stddev_pop(b) > 0 then covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) end, 6) + 0.0::DOUBLE as ic from x group by 1, 2""",
)
def _ic_by_period(spark, sf_dir):
    return rounded(diagnostics.ic_by_period(diagnostics.clean_factor(scored(spark, sf_dir))))


@_q(
    "alpha_beta",
    f"""with {SCORED}, k as (select trade_date, code, f, lead(close, 1) over o / close - 1 as period_1, lead(close, 5) over o / close - 1 as period_5, lead(close, 10) over o / close - 1 as period_10
  from e window o as (partition by code order by t)), c as (select * from k where f is not null and period_1 is not null and period_5 is not null and period_10 is not null),
w as (select *, f - avg(f) over (partition by trade_date) as w from c), l as (unpivot w on period_1, period_5, period_10 into name period value r),
d as (select trade_date, period, avg(r) as x, sum(w * r) / nullif(sum(abs(w)), 0) as y from l group by 1, 2), g as (
  select period, count(*) as n_dates, regr_slope(y, x) as beta, regr_intercept(y, x) as alpha from d where x is not null and y is not null group by 1)
select period, n_dates, round(alpha, 6) + 0.0::DOUBLE as alpha, round(beta, 6) + 0.0::DOUBLE as beta, round(ln(power(1 + alpha, 252 / split_part(period, '_', 2)::DOUBLE)), 6) + 0.0::DOUBLE as log_ann from g""",
)
def _alpha_beta(spark, sf_dir):
    found = diagnostics.alpha_beta(diagnostics.clean_factor(scored(spark, sf_dir)))
    return rounded(found.drop("ann_alpha"))


@_q(
    "quantile_turnover",
    f"""with {SCORED}, k as (select trade_date, t, code, f, lead(close, 1) over o as p1, lead(close, 5) over o as p5, lead(close, 10) over o as p10, close as p0 from e window o as (partition by code order by t)),
c as (select * from k where f is not null and p0 is not null and p1 is not null and p5 is not null and p10 is not null),
q as (select trade_date, quantile_cont(f, [0.2, 0.4, 0.6, 0.8]) as edges from c group by 1),
m as (select c.*, (1 + len(list_filter(edges, lambda v: f > v)))::INTEGER as factor_quantile, dense_rank() over (order by trade_date) as i from c join q using (trade_date))
select a.trade_date, a.factor_quantile, count(*) as n, round(case when any_value(a.i) > 5 then avg(case when b.factor_quantile = a.factor_quantile then 0.0 else 1.0 end) end, 6)::DOUBLE as turnover
from m a left join m b on b.code = a.code and b.i = a.i - 5 group by 1, 2""",
)
def _quantile_turnover(spark, sf_dir):
    """Quantiles of each date against those five dates earlier."""
    return rounded(diagnostics.quantile_turnover(diagnostics.clean_factor(scored(spark, sf_dir)), 5))


# ---- stored panels, histories in stretches, wide windows ---------------------------------------------------------


@_q("panel_stored", f"with {PANEL} select t, code, round(case when count(x) over w = 10 then avg(x) over w end, 6) + 0.0::DOUBLE as v from p window w as (partition by code order by t rows between 9 preceding and current row)")
def _panel_stored(spark, sf_dir):
    """A window over a panel that is kept bucketed by code, and read from there."""
    kept = panels.save(panel(spark, sf_dir, (X,)), f"panel_{uuid.uuid4().hex}", files.shared_folder(spark))
    out = evaluate(kept, {"v": parse(f"TsMean(${X},10)")})
    return rounded(out.select(F.col("t").cast("long").alias("t"), "code", "v"))


STRETCHED = {
    "mean": "TsMean($close,5)", "most": "TsMax($close,5)", "wma": "TsWMA($close,5)", "corr": "TsCorr($close,$vol,5)", "delta": "TsDelta($close,3)",
    "deep": "TsMean(TsDelta($close,2),3)", "ranked": "TsMean(Rank(TsMean($close,3)),4)", "median": "TsMed($close,4)",
}
_EV = lambda x, w, f: f"case when count({x}) over (o rows between {w - 1} preceding and current row) = {w} then {f} over (o rows between {w - 1} preceding and current row) end"


@_q(
    "events_stretches",
    f"""with a as (select cast(user_id as varchar) as code, strftime(ts, '%Y%m%d') as trade_date, avg(value) as close, count(*)::DOUBLE as vol from events group by all),
c as (select trade_date, row_number() over (order by trade_date) as t from (select distinct trade_date from a)),
p as (select c.t, c.trade_date, k.code, close, vol from c cross join (select distinct code from a) k left join a using (trade_date, code)),
q as (select *, close - lag(close, 2) over o as d2, {_EV("close", 3, "avg(close)")} as m3, case when vol is not null then close end as cx, case when close is not null then vol end as cy from p window o as (partition by code order by t)),
r as (select *, case when m3 is not null then row_number() over (partition by trade_date, m3 is null order by m3, code) / count(*) over (partition by trade_date, m3 is null) end as r3 from q)
select t, code, round({_EV("close", 5, "avg(close)")}, 6) + 0.0::DOUBLE as mean, round({_EV("close", 5, "max(close)")}, 6) + 0.0::DOUBLE as most,
  round(({_EV("close", 5, "sum(t * close)")} - (t - 5) * {_EV("close", 5, "sum(close)")}) / 15.0, 6) + 0.0::DOUBLE as wma,
  round(case when t >= 5 and count(cx) over f >= 2 and count(cx) over f * stddev_pop(cx) over f * stddev_pop(cy) over f > 1e-10 then covar_pop(cx, cy) over f / (stddev_pop(cx) over f * stddev_pop(cy) over f) end, 6) + 0.0::DOUBLE as corr,
  round(close - lag(close, 3) over o, 6) + 0.0::DOUBLE as delta, round({_EV("d2", 3, "avg(d2)")}, 6) + 0.0::DOUBLE as deep, round({_EV("r3", 4, "avg(r3)")}, 6) + 0.0::DOUBLE as ranked,
  round({_EV("close", 4, "median(close)")}, 6) + 0.0::DOUBLE as median
from r window o as (partition by code order by t), f as (partition by code order by t rows between 4 preceding and current row)""",
)
def _events_stretches(spark, sf_dir):
    """A user's days in stretches of seven: no task holds a whole history, every window finds the rows it reaches back to."""
    base = densify(adapters.events(spark, sf_dir), ["close", "vol"])
    out = evaluate(base, {k: parse(e) for k, e in STRETCHED.items()}, stretch=7)
    return rounded(out.select(F.col("t").cast("long").alias("t"), "code", *STRETCHED))


WIDE_WINDOWS = {"med": "TsMed($x,250)", "med_odd": "TsMed($x,101)", "rank": "TsRank($x,250)", "mad": "TsMad($x,250)"}
_WIDE = lambda w, f: f"case when count(x) over w{w} = {w} then {f} end"


@_q(
    "windows_wide",
    f"""with a as (select l_returnflag as code, strftime(l_shipdate, '%Y%m%d') as trade_date, avg(l_quantity) as x from lineitem group by all),
c as (select trade_date, row_number() over (order by trade_date) as t from (select distinct trade_date from a)),
p as (select c.t, k.code, x from c cross join (select distinct code from a) k left join a using (trade_date, code)),
h as (select t, code, x, {_WIDE(250, "median(x) over w250")} as med, {_WIDE(101, "median(x) over w101")} as med_odd, case when count(x) over w250 = 250 then list(x) over w250 end as held, avg(x) over w250 as m
  from p window w250 as (partition by code order by t rows between 249 preceding and current row), w101 as (partition by code order by t rows between 100 preceding and current row))
select t, code, round(med, 6) as med, round(med_odd, 6) as med_odd, round((len(list_filter(held, lambda v: v < x)) + (len(list_filter(held, lambda v: v = x)) + 1) / 2.0::DOUBLE) / 250, 6) as rank,
  round(list_sum(list_transform(held, lambda v: abs(v - m))) / 250, 6) as mad from h""",
)
def _windows_wide(spark, sf_dir):
    """Daily mean quantities by return flag: windows of 250 days slide over ordered values."""
    day = F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date")
    facts = adapters.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("code"), day).agg(F.avg("l_quantity").alias("x"))
    out = evaluate(densify(facts, ["x"]), {k: parse(e) for k, e in WIDE_WINDOWS.items()})
    return rounded(out.select(F.col("t").cast("long").alias("t"), "code", *WIDE_WINDOWS))


@_q(
    "ranks_wide",
    """with p as (select strftime(date_trunc('month', ts), '%Y%m%d') as trade_date, cast(event_id as varchar) as code, nullif(length(event_type), 5)::DOUBLE as x, value as y from events)
select trade_date, code, case when x is not null then row_number() over (partition by trade_date, x is null order by x, code) / count(*) over (partition by trade_date, x is null) end as rx,
  row_number() over (partition by trade_date order by y, code) / count(*) over (partition by trade_date) as ry from p""",
)
def _ranks_wide(spark, sf_dir):
    """Ranks of all events of a month by value, and by a figure of few values, some missing: each month is spread over all tasks."""
    rows = adapters.read(spark, sf_dir, "events").select(
        F.month("ts").alias("t"),
        F.date_format(F.date_trunc("month", "ts"), "yyyyMMdd").alias("trade_date"),
        F.col("event_id").cast("string").alias("code"),
        F.nullif(F.length("event_type"), F.lit(5)).cast("double").alias("x"),
        F.col("value").alias("y"),
    )
    out = evaluate(rows, {"rx": parse("Rank($x)"), "ry": parse("Rank($y)")}, apart=files.shared_folder(spark))
    return out.select("trade_date", "code", "rx", "ry")


# ---- batches of expressions --------------------------------------------------------------------------------------


def batch_sql(exprs: dict[str, Expr]) -> str:
    """CTEs up to l (expr_id, t, trade_date, code, fwd, close, f), for expressions that are rolling operators over fields
    with Rank, SLog1p, Sub and Div around them."""
    ts: dict[str, str] = {}
    lists, averages = set(), set()

    def rolling(call: Call) -> str:
        x, y = [a.name for a in call.args[:-1]] + [""] * (call.op not in ("TsCorr", "TsCov"))
        if call.op in ("TsRank", "TsMad"):
            lists.add(x)
        if call.op == "TsEMA":
            averages.add(x)
            sql = f"case when k_{x} >= {W} then exp(l_{x}) * s_{x} end"
        else:
            sql = OP_SQL[call.op][1]
            sql = re.sub(r"\bn = 10\b", "count(x) over w = 10", sql).replace("(a, lambda", f"(a_{x}, lambda")
            sql = re.sub(r"\bx\b", x, re.sub(r"\by\b", y, sql) if y else sql)
        return ts.setdefault(sql, f"c{len(ts)}")

    ranks: dict[str, str] = {}

    def value(e: Expr) -> str:
        if e.op == "Rank":
            return ranks.setdefault(rolling(e.args[0]), f"r{len(ranks)}")
        if e.op == "SLog1p":
            c = rolling(e.args[0])
            return f"sign({c}) * ln(1 + abs({c}))"
        a, b = (value(x) for x in e.args)
        return f"({a} - {b})" if e.op == "Sub" else f"case when abs({b}) >= 1e-9 then {a} / {b} end"

    values = {name: value(e) for name, e in exprs.items()}
    feats = ", ".join(f"{sql} as {f}" for f, sql in FEATURE_SQL.items() if f in PUBLIC)
    chain, last = [], "pall"
    for x in sorted(averages):
        ema = _EMA.replace("(select *, case when x is not null then t -", f"(select *, case when {x} is not null then t -")
        ema = re.sub(r"\bx\b", x, ema)
        for old in ("gap", "lp", "l", "k", "s"):
            ema = re.sub(rf"\b{old}\b", f"{old}_{x}", ema)
        for old, new in zip("ghiq", (f"{n}_{x}" for n in ("eg", "eh", "ei", "eq"))):
            ema = re.sub(rf"\b{old} as \(", f"{new} as (", re.sub(rf"from {old}\b", f"from {new}", ema))
        chain.append(ema.lstrip(", ").replace("from p\n", f"from {last}\n"))
        last = f"eq_{x}"
    framed = f"window w as (partition by code order by t rows between {W - 1} preceding and current row), o as (partition by code order by t)"
    held = "".join(f", list({x}) over w as a_{x}" for x in sorted(lists))
    parts = [
        PANEL,
        f"fall as (select code, trade_date, close as price, {feats} from feat)",
        "pall as (select c.t, c.trade_date, k.code, f.* exclude (code, trade_date, price), f.price as close, lead(f.price, 5) over (partition by k.code order by c.t) / f.price - 1 as fwd "
        "from cal c cross join (select distinct code from feat) k left join fall f using (trade_date, code))",
        *chain,
        f"ql as (select *{held} from {last} window w as (partition by code order by t rows between {W - 1} preceding and current row))",
        f"ts as (select t, trade_date, code, fwd, close, {', '.join(f'{sql} as {c}' for sql, c in ts.items())} from ql {framed})",
        "rk as (select *, " + ", ".join(
            f"case when {c} is not null then row_number() over (partition by trade_date, {c} is null order by {c}, code) / count(*) over (partition by trade_date, {c} is null) end as {r}"
            for c, r in ranks.items()
        ) + " from ts)",
        f"fin as (select t, trade_date, code, fwd, close, {', '.join(f'({v})::DOUBLE as {n}' for n, v in values.items())} from rk)",
        f"l as (select * from fin unpivot include nulls (f for expr_id in ({', '.join(values)})))",
    ]
    return ", ".join(parts)


#: From l to j (usable days with their IC), s (figures of each expression).
BATCH_STATS = f"""lp as (
  select *, row_number() over (partition by expr_id, t order by f, code) as rf, row_number() over (partition by expr_id, t order by fwd, code) as rr, count(*) over (partition by expr_id, t) as np
  from l where f is not null and fwd is not null
), d0 as (
  select expr_id, t, count(*) as n, stddev_pop(f) * stddev_pop(fwd) as s, covar_pop(f, fwd) as c, stddev_pop(rf) * stddev_pop(rr) as rs, covar_pop(rf, rr) as rc from lp group by 1, 2
), d as (
  select expr_id, t, case when n >= 10 and n * s > 1e-10 then c / s end as ic, case when n >= 10 and n * rs > 1e-10 then rc / rs end as r from d0
), u as (
  select expr_id, t, trade_date, count(f) as n, count(*) as cells from l group by 1, 2, 3
), j as (
  select u.expr_id, u.t, u.trade_date, row_number() over (partition by u.expr_id order by u.t) as u, ic, r, case when trade_date <= '{TRAIN_END}' then r end as a, case when trade_date >= '{TEST_START}' then r end as b
  from u left join d using (expr_id, t) where n >= {LEAST}
), cov as (select expr_id, sum(n) / sum(cells) as coverage from u group by 1
), s as (
  select expr_id, any_value(coverage) as coverage, count(j.t) as usable_days, avg(ic) as mean_ic, avg(ic) / nullif(stddev_pop(ic), 0) as icir, avg(r) as mean_rank_ic, avg(r) / nullif(stddev_pop(r), 0) as rank_icir,
    avg(case when j.t is null then null when r > 0 then 1.0::DOUBLE else 0.0::DOUBLE end) as pos, avg(a) as ta, avg(a) / nullif(stddev_pop(a), 0) as ti, avg(b) as sa, avg(b) / nullif(stddev_pop(b), 0) as si
  from cov left join j using (expr_id) group by 1
)"""
BATCH_COLUMNS = """round(coverage, 6) as coverage, usable_days, round(mean_ic, 6) + 0.0::DOUBLE as mean_ic, round(icir, 6) + 0.0::DOUBLE as icir, round(mean_rank_ic, 6) + 0.0::DOUBLE as mean_rank_ic,
  round(rank_icir, 6) + 0.0::DOUBLE as rank_icir, round(pos, 6) as positive_rank_ic_ratio, round(ta, 6) + 0.0::DOUBLE as train_mean_rank_ic, round(ti, 6) + 0.0::DOUBLE as train_rank_icir,
  round(sa, 6) + 0.0::DOUBLE as test_mean_rank_ic, round(si, 6) + 0.0::DOUBLE as test_rank_icir, round(abs(sa) * abs(si) * case when ta * sa > 0 then 1 else 0.25::DOUBLE end, 6) + 0.0::DOUBLE as score"""
BATCH = {f"e{i:03d}": parse(e) for i, e in enumerate(enumerate_templates(PUBLIC, windows=(W,), limit=64)[0])}


@_q("mining_batch", f"with {batch_sql(BATCH)}, {BATCH_STATS} select expr_id, {BATCH_COLUMNS} from s")
def mining_batch(spark, sf_dir):
    """Sixty-four template expressions, compiled together and scored in one pass."""
    base = densify(features(spark, sf_dir), [*PUBLIC, "close"]).withColumn("fwd", forward_return(5))
    wide = evaluate(base, BATCH, ["fwd"])
    return rounded(metrics.summarise(metrics.daily_of_many(wide, list(BATCH)), LEAST, TRAIN_END, TEST_START))


RUN = ["Rank(TsMean($ret_1d,10))", "Sub(Rank(TsMean($vol_log,10)),Rank(TsMean($ret_1d,10)))", "SLog1p(TsDelta($ret_1d,10))"]
REFUSED = {"Abs($none)": "UNKNOWN_FIELD:none", "Foo($ret_1d)": "UNKNOWN_OPERATOR:Foo", "Log($ret_1d)": "LOG_INPUT_UNSAFE", "Add($ret_1d": "PARSE_ERROR:Add($ret_1d", "TsMean($ret_1d,7)": "BAD_WINDOW:TsMean:7"}
_RUN_ROWS = " union all ".join(
    [f"select '{e}' as canonical, 'OK' as status, 'e{i}' as expr_id" for i, e in enumerate(RUN)] + [f"select '{e}', '{why}', 'none'" for e, why in REFUSED.items()]
)


def _run_sql(exprs: dict[str, Expr], rows: str) -> str:
    """All figures of expressions; rows: (canonical, status, expr_id)."""
    return f"""with {batch_sql(exprs)}, {BATCH_STATS}, tk as (
  select l.expr_id, l.code, j.u, row_number() over (partition by l.expr_id, l.t order by f, code) / count(*) over (partition by l.expr_id, l.t) as rk from l join j using (expr_id, t) where f is not null
), tm as (select *, lag(rk) over o as before, lag(u) over o as ub from tk window o as (partition by expr_id, code order by u)
), tp as (select expr_id, avg(case when ub = u - 1 then abs(rk - before) end) as turnover from tm group by 1
), q0 as (select expr_id, t, avg(case when rf / np >= 1 - 1 / 5.0::DOUBLE then fwd end) - avg(case when rf / np <= 1 / 5.0::DOUBLE then fwd end) as spread, count(*) as n from lp group by 1, 2
), qs as (select expr_id, avg(spread) as spread from q0 where n >= {LEAST} group by 1
), rr as ({rows})
select canonical, status, {BATCH_COLUMNS}, round(turnover, 6) as turnover_proxy, round(spread, 6) + 0.0::DOUBLE as quantile_spread from rr left join s using (expr_id) left join tp using (expr_id) left join qs using (expr_id)"""


@_q("mining_run", _run_sql({f"e{i}": parse(e) for i, e in enumerate(RUN)}, _RUN_ROWS))
def _mining_run(spark, sf_dir):
    """Good and bad expressions: each is a row, with its figures or with the reason why it has none."""
    config = mining.Config(windows=(W,), least=LEAST, least_spread=LEAST, train_end=TRAIN_END, test_start=TEST_START)
    return rounded(mining.results(features(spark, sf_dir), [*RUN, RUN[0], *REFUSED], config).drop("expr"))


#: Three batches of three, most of which read what another batch reads too.
SHARED = [
    "Rank(TsMean($ret_1d,10))", "Sub(Rank(TsMean($vol_log,10)),Rank(TsMean($ret_1d,10)))", "SLog1p(TsDelta($ret_1d,10))",
    "Div(Rank(TsMean($ret_1d,10)),Rank(TsStd($vol_log,10)))", "Rank(TsStd($vol_log,10))", "Sub(Rank(TsMax($ret_1d,10)),Rank(TsMean($vol_log,10)))",
    "SLog1p(TsMin($ret_1d,10))", "Rank(TsMax($ret_1d,10))", "Sub(Rank(TsDelta($ret_1d,10)),Rank(TsMean($ret_1d,10)))",
]
_SHARED_ROWS = " union all ".join(f"select '{e}' as canonical, 'OK' as status, 'e{i}' as expr_id" for i, e in enumerate(SHARED))


@_q("mining_shared", _run_sql({f"e{i}": parse(e) for i, e in enumerate(SHARED)}, _SHARED_ROWS))
def _mining_shared(spark, sf_dir):
    """A whole run in three batches with its store of shared sub-expressions; the rows that its result store holds at the end."""
    config = mining.Config(windows=(W,), least=LEAST, least_spread=LEAST, train_end=TRAIN_END, test_start=TEST_START, batch=3)
    out = files.shared_folder(spark)
    done = mining.run(features(spark, sf_dir), SHARED, config, out)
    found = store.ResultStore(spark, f"{out}/results").all(done["run_id"])
    return rounded(found.select("canonical", "status", *mining.FIGURES))


_FULL_ROWS = " union all ".join(f"select '{canonical(e)}' as canonical, 'OK' as status, '{i}' as expr_id" for i, e in BATCH.items())


@_q("mining_full", _run_sql(BATCH, _FULL_ROWS))
def _mining_full(spark, sf_dir):
    """The sixty-four expressions with all their figures, as a mining run scores a batch."""
    config = mining.Config(windows=(W,), least=LEAST, least_spread=LEAST, train_end=TRAIN_END, test_start=TEST_START)
    return rounded(mining.results(features(spark, sf_dir), [canonical(e) for e in BATCH.values()], config).drop("expr"))


_TOP_ROWS = " union all ".join(f"select '{e}' as canonical, 'OK' as status, 'e{i}' as expr_id" for i, e in enumerate(RUN))


@_q(
    "top_factors",
    f"""with x as ({_run_sql({f"e{i}": parse(e) for i, e in enumerate(RUN)}, _TOP_ROWS)})
select 'F' || lpad((row_number() over (order by score desc nulls last, canonical))::VARCHAR, 4, '0') || '_' || md5(canonical)[1:8] as factor_id, canonical as expr, score from x""",
)
def _top_factors(spark, sf_dir):
    """The results of a run as CSV, read again as numbered factors."""
    config = mining.Config(windows=(W,), least=LEAST, least_spread=LEAST, train_end=TRAIN_END, test_start=TEST_START)
    path = files.shared_folder(spark)
    tables.write_report(rounded(mining.results(features(spark, sf_dir), RUN, config)), path)
    return rounded(tables.read_top_factors(spark, path, 3))


@_q("pool_json", f"with {BARS} select code, trade_date, close from feat where code in (select cast(s_suppkey as varchar) from supplier where s_acctbal > 5000)")
def _pool_json(spark, sf_dir):
    """A pool written as a JSON array and read again selects the rows of its codes."""
    path = files.shared_folder(spark)
    tables.write_pool(adapters.read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("code")), path)
    return rounded(adapters.bars(spark, sf_dir).join(tables.read_pool(spark, path), "code", "left_semi").select("code", "trade_date", "close"))


PORTFOLIOS = {"f1": parse("Rank(TsMean($ret_1d,10))"), "f2": parse("Rank(TsDelta($vol_log,10))")}


@_q(
    "backtest_batch",
    f"""with {batch_sql(PORTFOLIOS)}, {BATCH_STATS}, w0 as (
  select l.expr_id as factor_id, top_pct, l.t, l.trade_date, code, close, case when mean_rank_ic >= 0 then f else -f end as f
  from l join s using (expr_id) cross join (select unnest([0.05::DOUBLE, 0.1::DOUBLE]) as top_pct)
), w1 as (
  select *, count(f) over (partition by factor_id, top_pct, t) as n, row_number() over (partition by factor_id, top_pct, t, f is null order by f desc, code) as place from w0
), w2 as (
  select *, case when (t - 1) % 5 = 0 and n > 0 then case when f is not null and place <= greatest(1, floor(n * top_pct)) then 1 / greatest(1, floor(n * top_pct)) else 0 end end as fresh from w1
), w3 as (
  select *, coalesce(last_value(fresh ignore nulls) over (partition by factor_id, top_pct, code order by t rows unbounded preceding), 0) as w from w2
), r0 as (
  select factor_id, top_pct, t, lead(trade_date) over o as d, coalesce(w * (lead(close) over o / close - 1), 0) as g, abs(lead(w) over o - w) as c from w3 window o as (partition by factor_id, top_pct, code order by t)
), r1 as (select factor_id, top_pct, t, d as trade_date, sum(c) as turnover, sum(g) - sum(c) * 15 / 1e4 as net from r0 where d is not null group by 1, 2, 3, 4)
select factor_id, top_pct, trade_date, round(turnover, 6) as turnover, round(net, 6) + 0.0::DOUBLE as net,
  round(sum(ln(1 + net)) over (partition by factor_id, top_pct order by t), 6) + 0.0::DOUBLE as log_equity from r1""",
)
def _backtest_batch(spark, sf_dir):
    """Two factors and two portfolio sizes, each in the direction of its rank IC, with a curve of its own."""
    base = densify(features(spark, sf_dir), [X, Y, "close"]).withColumn("fwd", forward_return(5))
    wide = evaluate(base, PORTFOLIOS, ["fwd", "close"])
    found = metrics.summarise(metrics.daily_of_many(wide, list(PORTFOLIOS)), LEAST).withColumnRenamed("expr_id", "factor_id")
    long = long_form(wide, list(PORTFOLIOS), ["close"]).withColumnRenamed("expr_id", "factor_id")
    curves = backtest.equity(backtest.run(long, found))
    return rounded(curves.select("factor_id", F.col("top_pct"), "trade_date", "turnover", "net", F.ln("equity").alias("log_equity")))


#: Scores of a validation share ties, and ask only that ranks differ.
_AVERAGE = (
    ("row_number() over (partition by expr_id, t order by f, code) as rf", "rank() over (partition by expr_id, t order by f) + (count(*) over (partition by expr_id, t, f) - 1) / 2.0 as rf"),
    ("row_number() over (partition by expr_id, t order by fwd, code) as rr", "rank() over (partition by expr_id, t order by fwd) + (count(*) over (partition by expr_id, t, fwd) - 1) / 2.0 as rr"),
    ("n * s > 1e-10", "s > 0"),
    ("n * rs > 1e-10", "rs > 0"),
)
VALIDATED = {"f1": parse("Rank(TsMean($ret_1d,10))"), "f2": parse("Rank(TsMax($ret_1d,10))")}
_PORTFOLIO_SQL = ORACLE["backtest_batch"].split("\nselect factor_id, top_pct, trade_date")[0].replace(batch_sql(PORTFOLIOS), batch_sql(VALIDATED))
_PORTFOLIO_SQL = reduce(lambda sql, change: sql.replace(*change), _AVERAGE, _PORTFOLIO_SQL)


@_q(
    "validation_run",
    f"""{_PORTFOLIO_SQL}, c1 as (select *, exp(sum(ln(1 + net)) over (partition by factor_id, top_pct order by t)) as equity from r1), c2 as (
  select *, greatest(max(equity) over (partition by factor_id, top_pct order by t), 1) as peak, case when trade_date <= '{TRAIN_END}' then net end as a, case when trade_date >= '{TEST_START}' then net end as b from c1
), c3 as (
  select factor_id, top_pct, arg_max(equity, t) as last, min(equity / peak - 1) as dd, avg(case when net > 0 then 1.0 else 0.0 end) as wr, avg(a) * 252 as ar, stddev_pop(a) * sqrt(252) as av, avg(b) * 252 as br,
    stddev_pop(b) * sqrt(252) as bv, avg(turnover) as turn from c2 group by 1, 2
)
select factor_id, top_pct, case when mean_rank_ic >= 0 then 1 else -1 end::INTEGER as direction, round(ln(last), 6) as log_total_return, round(dd, 6) as max_drawdown, round(wr, 6)::DOUBLE as win_rate,
  round(ar, 6) as ann_return, round(av, 6) as ann_vol, round(ar / av, 6) as sharpe, round(br, 6) as test_ann_return, round(br / bv, 6) as test_sharpe, round(turn, 6) as avg_turnover, round(ar / -dd, 6) as calmar,
  {BATCH_COLUMNS} from c3 join s on s.expr_id = c3.factor_id""",
)
def _validation_run(spark, sf_dir):
    """A whole validation of two factors: the portfolio summary with the scores by which they were directed, as written."""
    config = validation.Config(windows=(W,), least=LEAST, least_bucket=LEAST, train_end=TRAIN_END, test_start=TEST_START, clean=1)
    factors = spark.createDataFrame([(k, canonical(e)) for k, e in VALIDATED.items()], "factor_id string, expr string")
    found = validation.run(features(spark, sf_dir), factors, config, files.shared_folder(spark))
    rows = found["portfolio_summary"].join(found["factor_metrics_summary"], "factor_id")
    return rounded(rows.withColumn("log_total_return", F.log1p("total_return")).drop("total_return"))
