import json
import math

import numpy as np
import pandas as pd
import pytest

from loomfactor.functions.features import OTHER, PUBLIC, with_features
from loomfactor.operators import backtest, groups, metrics
from loomfactor.operators.panel import densify, forward_return
from loomfactor.operators.registry import OPS
from loomfactor.plans import mining, validation
from loomfactor.plans.compile import evaluate, long_form
from loomfactor.plans.expressions import Limits, Validator, canonical, parse
from loomfactor.plans.grammar import enumerate_templates, read_range, save_templates
from loomfactor.sources import store, tables
from loomfactor.streaming import incremental


@pytest.fixture(scope="module")
def holed(spark):
    """A random panel with holes, ties, a constant run, and a code that starts late."""
    rng = np.random.default_rng(11)
    rows = []
    for c in range(14):
        for t in range(45):
            if rng.random() < 0.12 or (c == 3 and t < 12):
                continue
            x = 1.0 if c == 5 and t < 25 else round(float(rng.normal()), 1)
            rows.append((f"2024{t:04d}", f"c{c:02d}", x, float(rng.normal()), float(10 + rng.random())))
    return rows, spark.createDataFrame(rows, "trade_date string, code string, x double, y double, close double")


def wide(rows, column):
    frame = pd.DataFrame(rows, columns=["d", "c", "x", "y", "close"])
    return frame.pivot(index="d", columns="c", values=column).sort_index()


def values(df, expr):
    out = evaluate(densify(df, ["x", "y", "close"]), {"v": parse(expr)}).toPandas()
    return out.pivot(index="trade_date", columns="code", values="v").sort_index().to_numpy(dtype=float)


PANDAS = {
    "TsMean": lambda r: r.mean(),
    "TsStd": lambda r: r.std(ddof=0),
    "TsMed": lambda r: r.median(),
    "TsSkew": lambda r: r.skew(),
    "TsKurt": lambda r: r.kurt(),
    "TsMad": lambda r: r.apply(lambda a: np.abs(a - a.mean()).mean(), raw=True),
    "TsRank": lambda r: r.apply(lambda a: pd.Series(a).rank(pct=True).iloc[-1], raw=True),
    "TsWMA": lambda r: r.apply(lambda a: (a * np.arange(1, 11)).sum() / 55, raw=True),
}


@pytest.mark.parametrize("op", PANDAS)
def test_rolling_against_pandas(holed, op):
    rows, df = holed
    want = PANDAS[op](wide(rows, "x").rolling(10, min_periods=10)).to_numpy()
    np.testing.assert_allclose(values(df, f"{op}($x,10)"), want, atol=1e-7)


def test_ema_corr_and_rank(holed):
    rows, df = holed
    x, y = wide(rows, "x"), wide(rows, "y")
    want = x.ewm(span=10, adjust=False, min_periods=10).mean().to_numpy()
    np.testing.assert_allclose(values(df, "TsEMA($x,10)"), want, atol=1e-9)
    pair = x.notna() & y.notna()
    got = values(df, "TsCorr($x,$y,10)")
    for i in range(len(x)):
        for j in range(x.shape[1]):
            ok = pair.iloc[max(0, i - 9) : i + 1, j].to_numpy()
            a, b = (v.iloc[max(0, i - 9) : i + 1, j].to_numpy()[ok] for v in (x, y))
            if i >= 9 and len(a) >= 5 and math.sqrt(((a - a.mean()) ** 2).sum() * ((b - b.mean()) ** 2).sum()) > 1e-10:
                assert got[i, j] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
            else:
                assert np.isnan(got[i, j])
    rank = values(df, "Rank($x)")
    want = x.T.rank(method="first", pct=True).T.to_numpy()
    np.testing.assert_allclose(rank, want, atol=1e-12)


def test_ranks_together_equal_ranks_apart(holed):
    _, df = holed
    panel = densify(df, ["x", "y", "close"])
    exprs = {f"e{i}": parse(e) for i, e in enumerate(["Rank($x)", "Rank($y)", "Rank(TsMean($x,10))", "Sub(Rank(TsStd($y,10)),Rank(TsMean($x,10)))", "Rank(TsDelta($x,10))"])}
    both = evaluate(panel, exprs).toPandas().set_index(["t", "code"]).sort_index()
    for name, node in exprs.items():
        one = evaluate(panel, {"v": node}).toPandas().set_index(["t", "code"]).sort_index()
        np.testing.assert_allclose(both[name].to_numpy(float), one["v"].to_numpy(float), atol=1e-12)


def test_metrics_invariants(holed):
    """IC does not change with scale, rank IC not with a monotone map; a factor equal to the return scores 1."""
    _, df = holed
    panel = densify(df, ["x", "y", "close"]).withColumn("fwd", forward_return(5))
    from pyspark.sql import functions as F

    panel = panel.withColumns({"perfect": F.col("fwd"), "scaled": 3 * F.col("y") + 2, "cubed": F.pow("y", F.lit(3.0))})
    long = long_form(panel, ["perfect", "y", "scaled", "cubed"], ["fwd"])
    got = metrics.summary(long, 10).toPandas().set_index("expr_id")
    assert got.loc["perfect", "mean_ic"] == pytest.approx(1) and got.loc["perfect", "mean_rank_ic"] == pytest.approx(1)
    assert got.loc["scaled", "mean_ic"] == pytest.approx(got.loc["y", "mean_ic"], abs=1e-12)
    assert got.loc["cubed", "mean_rank_ic"] == pytest.approx(got.loc["y", "mean_rank_ic"], abs=1e-12)
    assert got.loc["y", "score"] is None or math.isnan(got.loc["y", "score"])


def test_portfolio_holds_weights_between_turns(spark):
    from pyspark.sql import functions as F

    rows = [(t, f"2024{t:04d}", f"c{c}", None if t in (6, 7) else float(c), 10.0 + c + t) for t in range(1, 13) for c in range(10)]
    df = spark.createDataFrame(rows, "t int, trade_date string, code string, f double, close double")
    weighted = backtest.top_weights(df, 0.2, every=5)
    sums = weighted.groupBy("t").agg(F.sum("w").alias("s"), F.count_if(F.col("w") > 0).alias("n")).collect()
    assert all(r.s == pytest.approx(1) and r.n == 2 for r in sums)
    daily = backtest.returns(weighted).orderBy("t").collect()
    assert len(daily) == 11 and daily[0].turnover == 0
    held = [10.0 + c + 1 for c in (8, 9)]
    assert daily[0].gross == pytest.approx(sum(0.5 / p for p in held))


@pytest.mark.parametrize(
    "expr, reason",
    [
        ("Rank(TsMean($x,10))", "OK"), ("$z", "UNKNOWN_FIELD:z"), ("Foo($x)", "UNKNOWN_OPERATOR:Foo"), ("Abs($x,$y)", "ARITY:Abs"),
        ("TsMean($x)", "ROLLING_NEEDS_WINDOW:TsMean"), ("TsMean($x,$y)", "ROLLING_NEEDS_WINDOW:TsMean"), ("TsMean($x,7)", "BAD_WINDOW:TsMean:7"),
        ("TsCorr($x,$y)", "PAIR_ROLLING_NEEDS_WINDOW:TsCorr"), ("TsCorr($x,$y,11)", "BAD_WINDOW:TsCorr:11"), ("Log($x)", "LOG_INPUT_UNSAFE"),
        ("Log(Abs($x))", "OK"), ("Pow($x,4)", "POW_ONLY_CONSTANT_0.5_2_3"), ("Pow($x,2)", "OK"), ("Abs(Abs(Abs(Abs($x))))", "DEPTH_EXCEEDED:5"),
        ("TsMean(TsMean(TsMean($x,10),10),10)", "TS_OPS_EXCEEDED:3"), ("Add(Add($x,$y),$x)", "BINARY_OPS_EXCEEDED:2"),
        ("TsCorr(TsCorr($x,$y,10),$y,10)", "PAIR_OPS_EXCEEDED:2"),
    ],
)
def test_validator_reasons(expr, reason):
    assert Validator({"x", "y"}).check(parse(expr)) == reason


def test_parse_and_canonical():
    assert canonical(parse(" Add( $y , $x ) ")) == canonical(parse("Add($x,$y)")) == "Add($x,$y)"
    assert canonical(parse("TsCorr($y,$x,10)")) == "TsCorr($y,$x,10)"
    assert parse("1e3").value == 1000.0
    for bad in ("Add($x", "x y", "$", ""):
        with pytest.raises(ValueError, match="PARSE_ERROR"):
            parse(bad)
    assert Validator({"x"}, limits=Limits(nodes=1)).check(parse("Abs($x)")) == "NODES_EXCEEDED:2"
    assert len(OPS) == 36


def test_templates(spark, tmp_path):
    found, stats = enumerate_templates(PUBLIC)
    assert stats == {"single_field": 2100, "binary": 6525, "pair_corr": 765, "directional": 75, "total": 9465}
    assert len(found) == len({canonical(parse(e)) for e in found}) == 9465
    told = save_templates(spark, str(tmp_path / "e"), ["ret_1d", "vol_log"], windows=(10,))
    assert json.loads((tmp_path / "expression_stats.json").read_text()) == told == save_templates(spark, str(tmp_path / "e"), ["ret_1d", "vol_log"], windows=(10,))
    rows = read_range(spark, str(tmp_path / "e"), 2, 4).collect()
    assert sorted(r.idx for r in rows) == [2, 3, 4] and all(parse(r.expr) for r in rows)


def test_features_with_missing_columns_and_edges(spark):
    df = spark.createDataFrame([("a", "1", 2.0, 0.0), ("a", "2", None, 1e-12), ("a", "3", 3.0, 2.0)], "code string, trade_date string, close double, pre_close double")
    out = with_features(df)
    assert set(PUBLIC) | set(OTHER) <= set(out.columns)
    rets = {r.trade_date: r.ret_1d for r in out.collect()}
    assert rets == {"1": None, "2": 0.0, "3": 0.5}


def test_store_resumes_and_keeps_the_latest(spark, tmp_path):
    s = store.ResultStore(spark, str(tmp_path / "r"))
    wanted = spark.createDataFrame([("a",), ("b",)], "canonical string")
    assert s.remaining("r1", wanted).count() == 2
    s.upsert(spark.createDataFrame([("r1", "a", 1.0)], "run_id string, canonical string, score double"))
    s.upsert(spark.createDataFrame([("r1", "a", 2.0), ("r1", "c", None)], "run_id string, canonical string, score double"))
    assert [(r.canonical, r.score) for r in s.all("r1").collect()] == [("a", 2.0), ("c", None)]
    assert [r.canonical for r in s.remaining("r1", wanted).collect()] == ["b"]
    assert store.run_id({"a": 1}) != store.run_id({"a": 2})


def test_sources(spark, tmp_path):
    (tmp_path / "pool.json").write_text('["000001.SZ", "000003.SZ", "000003.SZ"]')
    market = tables.simulate(spark, 20, 6)
    assert market.count() == 120 and market.filter("high < low or close <= 0").count() == 0
    pool = tables.read_pool(spark, str(tmp_path / "pool.json"))
    daily = market.select("code", "trade_date", "close")
    out = tables.market(daily, [market.select("code", "trade_date", "amount")], market.select("code", "industry").distinct(), "20240101", "20241231", pool)
    assert out.count() == 40 and set(out.columns) == {"code", "trade_date", "close", "amount", "industry"}
    market.limit(1).createOrReplaceTempView("known_table")
    assert tables.resolve(spark, ["no_such_table", "known_table", "other"]) == "known_table" and tables.resolve(spark, ["none_a", "none_b"]) == "none_a"
    ids = tables.factor_ids(spark.createDataFrame([("Abs($x)", 0.5), ("Abs($x)", 0.5), ("Inv($x)", 0.9), (None, 1.0)], "expr string, score double"))
    assert [r.factor_id[:5] for r in ids.orderBy("factor_id").collect()] == ["F0001", "F0002"] and ids.orderBy("factor_id").first().expr == "Inv($x)"


def test_incremental_stream_counts_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], "k string, v int, x double").write.parquet(src)
    incremental.follow(spark, src, "k string, v int, x double", out, ck).awaitTermination()
    spark.createDataFrame([("a", 2, 5.0)], "k string, v int, x double").write.mode("append").parquet(src)
    incremental.follow(spark, src, "k string, v int, x double", out, ck).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == 3
    assert {(r.k, r.x) for r in incremental.newest(rows, ["k"], "v").collect()} == {("a", 5.0), ("b", 1.0)}
    assert incremental.beyond(rows, rows.filter("v = 1"), "v").count() == 1


def test_constants_keep_all_digits(holed):
    _, df = holed
    assert canonical(parse("Mul($x,1234567)")) != canonical(parse("Mul($x,1234568)")) and canonical(parse("Pow($x,0.5)")) == "Pow($x,0.5)"
    out = evaluate(densify(df, ["x"]), {"a": parse("Mul($x,1234567)"), "b": parse("Mul($x,1234568)")}).dropna().toPandas()
    x = out.b - out.a
    np.testing.assert_allclose(out.a, x * 1234567, rtol=1e-6)


def test_long_averages_lose_nothing(spark):
    """Six thousand dense rows, a code with a gap, and one that starts late, against pandas."""
    rng = np.random.default_rng(1)
    x = pd.DataFrame(rng.normal(size=(6000, 3)), columns=list("abc"))
    x.loc[1000:4800, "b"] = np.nan
    x.loc[:700, "c"] = np.nan
    rows = [(t + 1, f"{t:08d}", c, None if np.isnan(v) else float(v)) for c in "abc" for t, v in enumerate(x[c])]
    df = spark.createDataFrame(rows, "t int, trade_date string, code string, x double")
    for w in (10, 50):
        got = evaluate(df, {"v": parse(f"TsEMA($x,{w})")}).toPandas().pivot(index="trade_date", columns="code", values="v").to_numpy(float)
        np.testing.assert_allclose(got, x.ewm(span=w, adjust=False, min_periods=w).mean().to_numpy(), atol=1e-9)


def test_ranks_inside_windows_inside_ranks(holed):
    """Windows over ranks over windows, one argument used at several depths."""
    _, df = holed
    panel = densify(df, ["x", "y", "close"])
    texts = ["TsCorr(Rank(TsMean($x,10)),$y,10)", "TsMean($y,10)", "Rank(TsEMA($y,10))", "Rank(TsMean(Rank($x),10))", "Rank($y)", "Sub(Rank(TsStd($y,10)),$close)"]
    both = evaluate(panel, {f"e{i}": parse(t) for i, t in enumerate(texts)}, ["close"]).toPandas().set_index(["t", "code"]).sort_index()
    for i, text in enumerate(texts):
        one = evaluate(panel, {"v": parse(text)}).toPandas().set_index(["t", "code"]).sort_index()
        np.testing.assert_allclose(both[f"e{i}"].to_numpy(float), one["v"].to_numpy(float), atol=1e-12)


def test_many_are_scored_as_one_by_one(holed):
    _, df = holed
    wide = densify(df, ["x", "y", "close"]).withColumn("fwd", forward_return(5))
    got, want = (
        d.orderBy("expr_id", "t").toPandas() for d in (metrics.daily_of_many(wide, ["x", "y"]), metrics.daily(long_form(wide, ["x", "y"], ["fwd"])))
    )
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False, atol=1e-12)


def test_equity_follows_the_product_of_any_returns(spark):
    nets = {"a": [0.1, -0.2, 0.05], "b": [0.5, -1.5, -1.5, 0.1], "c": [0.1, -1.0, 0.3]}
    rows = [(k, 0.1, t, str(t), 0.0, 0.0, n) for k, v in nets.items() for t, n in enumerate(v)]
    df = spark.createDataFrame(rows, "factor_id string, top_pct double, t int, trade_date string, gross double, turnover double, net double")
    got = backtest.equity(df).toPandas().sort_values(["factor_id", "t"])
    for k, v in nets.items():
        np.testing.assert_allclose(got[got.factor_id == k].equity, np.cumprod(1 + np.array(v)))
    stats = {r.factor_id: r for r in backtest.stats(df, "1", "2").collect()}
    assert stats["c"].total_return == -1 and stats["a"].total_return == pytest.approx(1.1 * 0.8 * 1.05 - 1) and len(stats) == 3


def test_overall_rank_of_a_whole_table(spark):
    from pyspark.sql import functions as F

    from loomfactor.operators import groups

    rng = np.random.default_rng(3)
    values = [None if i % 50 == 0 else float(v) for i, v in enumerate(rng.integers(0, 300, 900))]
    df = spark.createDataFrame([(f"{i:04d}", v) for i, v in enumerate(values)], "code string, v double")
    got = {r.code: r.r for r in df.select("code", groups.overall_rank(df, "v", "code").alias("r")).collect()}
    want = sorted(range(900), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert [got[f"{i:04d}"] for i in want] == list(range(1, 901))
    assert df.limit(0).select(groups.overall_rank(df.limit(0), "v", "code")).count() == 0


def test_mining_run_scores_resumes_and_writes(spark, tmp_path):
    """The simulated market end to end: bad expressions are rows, a second run goes on, every output is there."""
    market = with_features(tables.simulate(spark, 60, 24, seed=7))
    assert not set(PUBLIC) - {c for c in market.columns if market.filter(f"`{c}` is not null").count()}
    config = mining.Config(windows=(10,), least=10, least_spread=10, train_end="20240229", test_start="20240301", batch=4)
    wanted = [*enumerate_templates(PUBLIC, windows=(10,), limit=7)[0], "Abs($none)", "not one ("]
    out = str(tmp_path / "run")
    first = mining.run(market, wanted[:5], config, out, data="sim")
    assert first["n_exprs"] == first["n_results"] == 5 and first["n_resumed"] == 0
    done = mining.run(market, wanted, config, out, data="sim")
    assert (done["n_results"], done["n_resumed"], done["run_id"]) == (9, 5, first["run_id"])
    assert (done["n_dates"], done["n_codes"], done["n_raw_rows"]) == (60, 24, 1440)
    rows = {r.canonical: r for r in store.ResultStore(spark, f"{out}/results").all(done["run_id"]).collect()}
    assert rows["Abs($none)"].status == "UNKNOWN_FIELD:none" and rows["not one ("].status.startswith("PARSE_ERROR")
    good = [r for r in rows.values() if r.status == "OK"]
    assert len(good) == 7 and all(r.usable_days > 0 and r.coverage > 0.5 and r.turnover_proxy is not None for r in good)
    for name in ("raw", "expressions", "factor_results", "top100", "summary", "checkpoints"):
        assert (tmp_path / "run" / name).exists()
    best = spark.read.option("header", True).csv(f"{out}/top100")
    assert best.count() == 9 and len(read_range(spark, f"{out}/expressions", 1, 99).collect()) == 9
    top = tables.read_top_factors(spark, f"{out}/factor_results", 3).collect()
    assert len(top) == 3 and all(r.factor_id[5:] == "_" + __import__("hashlib").md5(r.expr.encode()).hexdigest()[:8] for r in top)


def test_a_failing_expression_gets_an_error_row(spark, tmp_path, monkeypatch):
    from pyspark.errors import AnalysisException

    good = mining.score

    def sometimes(base, planned, config, given=None, days=16):
        if any(p.key == "Abs($ret_1d)" for p in planned):
            raise AnalysisException("no such thing")
        return good(base, planned, config, given, days)

    monkeypatch.setattr(mining, "score", sometimes)
    market = with_features(tables.simulate(spark, 30, 12, seed=3))
    out = str(tmp_path / "run")
    done = mining.run(market, ["Rank($ret_1d)", "Abs($ret_1d)", "Rank($vol_log)"], mining.Config(windows=(10,), least=5), out)
    rows = {r.canonical: r.status for r in store.ResultStore(spark, f"{out}/results").all(done["run_id"]).collect()}
    assert rows["Abs($ret_1d)"].startswith("EVAL_ERROR:AnalysisException") and list(rows.values()).count("OK") == 2


def test_validation_run_writes_all_its_tables(spark, tmp_path):
    market = with_features(tables.simulate(spark, 50, 20, seed=5))
    (tmp_path / "top.csv").write_text("\ufeffcanonical,score\n" + '"Rank(TsMean($ret_1d,10))",0.5\n"Rank(TsDelta($vol_log,10))",0.7\n"Rank($none)",0.9\n"Rank($none)",0.9\n,1\n')
    factors = tables.read_top_factors(spark, str(tmp_path / "top.csv"))
    assert [r.expr for r in factors.orderBy("factor_id").collect()] == ["Rank($none)", "Rank(TsDelta($vol_log,10))", "Rank(TsMean($ret_1d,10))"]
    config = validation.Config(windows=(10,), least=8, least_bucket=8, train_end="20240215", test_start="20240216", clean=1, max_loss=0.9)
    out = str(tmp_path / "val")
    found = validation.run(market, factors, config, out)
    assert sorted(r.status for r in found["factor_compute_status"].collect()) == ["OK", "OK", "UNKNOWN_FIELD:none"]
    assert found["factor_metrics_summary"].count() == 2 and found["portfolio_summary"].count() == 4
    assert found["equity_curves"].groupBy("factor_id", "top_pct").count().filter("count = 49").count() == 4
    assert [r.bucket for r in found["group_metrics_by_size"].collect()].count("mega") == 1 and found["group_metrics_by_industry"].count() == 8
    assert {n.split("_F")[0] for n in found} >= {"rolling_ic", "quantile_returns", "ic_by_period"}
    assert spark.read.option("header", True).csv(f"{out}/csv/portfolio_summary").count() == 4 and (tmp_path / "val" / "csv" / "rolling_ic").exists()
    assert tables.read_factor(spark, f"{out}/panels", found["factor_metrics_summary"].first().factor_id).count() == 1000


def test_a_validation_ranks_its_cells_once(spark, tmp_path, monkeypatch):
    market = with_features(tables.simulate(spark, 20, 12, seed=5))
    factors = spark.createDataFrame([("f1", "Rank($ret_1d)")], "factor_id string, expr string")
    out, good, calls, plans = str(tmp_path / "val"), metrics.daily, [], []
    monkeypatch.setattr(metrics, "daily", lambda *a: calls.append(1) or good(*a))
    run = validation.backtest.run
    monkeypatch.setattr(validation.backtest, "run", lambda *a, **k: plans.append(run(*a, **k)) or plans[0])
    found = validation.run(market, factors, validation.Config(least=5, least_bucket=5, clean=0), out)
    # The portfolios read the written scores, and rank before there is a row for each size.
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "stddev" not in plan.lower() and plan.index("Generate explode") < plan.index("row_number(")
    assert spark.read.parquet(f"{out}/raw").columns == ["code", "trade_date", "industry", "ret_1d", "close", "circ_mv"]
    assert found["rolling_ic"].count() == spark.read.parquet(f"{out}/daily").count() == 20 and found["portfolio_summary"].count() == 2


def test_industry_map_takes_the_last_known_industry(spark):
    rows = [("a", "20240102", "steel"), ("a", "20240101", "coal"), ("a", "20240103", None), ("b", "20240101", None), ("c", None, "banks")]
    out = groups.industry_map(spark.createDataFrame(rows, "code string, trade_date string, industry string"))
    assert {r.code: r.industry for r in out.collect()} == {"a": "steel", "b": "UNKNOWN", "c": "UNKNOWN"}
    assert groups.industry_map(spark.createDataFrame([], "code string, trade_date string, industry string")).count() == 0
