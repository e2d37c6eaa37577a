"""Runs over several batches, kept panels, wide windows, histories in stretches, the store and incremental loads."""

import datetime as dt
import re
import threading

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfactor.functions.features import PUBLIC, with_features
from loomfactor.operators import diagnostics, frames, metrics, sliding
from loomfactor.operators.panel import densify, forward_return
from loomfactor.operators.registry import OPS, Op
from loomfactor.plans import mining, shared
from loomfactor.plans.compile import evaluate, long_form
from loomfactor.plans.expressions import canonical, parse
from loomfactor.sources import adapters, files, panels, store, tables
from loomfactor.streaming import incremental
from tests.test_engine import holed  # noqa: F401

BATCHES = [
    ["Rank(TsMean($ret_1d,10))", "Sub(Rank(TsMean($vol_log,10)),Rank(TsMean($ret_1d,10)))", "TsStd($ret_1d,10)"],
    ["Div(Rank(TsMean($ret_1d,10)),TsStd($ret_1d,10))", "TsCorr($ret_1d,$vol_log,10)", "Rank($ret_1d)"],
    ["Sub(Rank(TsMean($vol_log,10)),TsMean($vol_log,10))", "Abs($ret_1d)", "TsMean(TsStd($ret_1d,10),10)"],
]


def trees(batches=BATCHES):
    return [[parse(e) for e in b] for b in batches]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_several_batches_read_is_chosen():
    chosen = [canonical(x) for x in shared.choose(trees())]
    # A window that stands inside a kept rank only is not kept; one that a batch reads by itself too is.
    assert chosen == ["TsMean($vol_log,10)", "Rank(TsMean($ret_1d,10))", "Rank(TsMean($vol_log,10))", "TsStd($ret_1d,10)"]
    assert shared.choose(trees(BATCHES[:1])) == [] and shared.choose([]) == []
    assert [canonical(x) for x in shared.choose(trees(), most=1)] == ["Rank(TsMean($ret_1d,10))"]


def test_each_shared_window_is_computed_once(spark, tmp_path):
    base = mining.base_panel(with_features(tables.simulate(spark, 40, 12, seed=3)), mining.Config())
    with panels.co_located(spark):
        kept = panels.save(base, "once_base", str(tmp_path / "base"), 4)
        chosen, computed = shared.choose(trees()), []
        held = shared.Store(kept, str(tmp_path / "kept"))
        for x in chosen:  # what is kept before is read, what is not yet is computed
            computed += held.windows([x])
            held.build([x])
        for batch in trees():
            computed += held.windows(batch)
        every = {canonical(y) for b in trees() for x in b for y in shared.parts(x) if shared.windowed(y)}
        assert sorted(computed) == sorted(every)
        for batch in trees():
            panel, given = held.panel(batch)
            names = {f"v{i}": x for i, x in enumerate(batch)}
            got = evaluate(panel, names, given=given)
            want = evaluate(base, names)
            a, b = (d.orderBy("t", "code").toPandas() for d in (got, want))
            pd.testing.assert_frame_equal(a, b, atol=1e-12)
        first = held.panel(trees()[0][:1])
        only = evaluate(first[0], {"v": trees()[0][0]}, given=first[1])
        assert "Window" not in plan_of(only) and "Exchange" not in plan_of(only).replace("BroadcastExchange", "")
        held.release()
        panels.drop(spark, "once_base", str(tmp_path / "base"))
    assert not list((tmp_path / "kept").iterdir()) and not (tmp_path / "base").exists()


def test_windows_on_a_kept_panel_need_no_exchange(spark, tmp_path, holed):  # noqa: F811
    rows, df = holed
    kept = panels.save(densify(df, ["x", "y", "close"]), "kept_plain", str(tmp_path / "k"), 8)
    out = evaluate(kept, {"m": parse("TsMean($x,10)"), "c": parse("TsCorr($x,$y,10)")})
    assert "Exchange" not in plan_of(out) and "Window" in plan_of(out)
    want = evaluate(densify(df, ["x", "y", "close"]), {"m": parse("TsMean($x,10)"), "c": parse("TsCorr($x,$y,10)")})
    pd.testing.assert_frame_equal(*(d.orderBy("t", "code").toPandas() for d in (out, want)), atol=1e-12)
    panels.drop(spark, "kept_plain", str(tmp_path / "k"))


def test_a_run_in_batches_equals_one_batch(spark, tmp_path):
    market = with_features(tables.simulate(spark, 60, 24, seed=7))
    wanted = [e for b in BATCHES for e in b]
    options = dict(windows=(10,), least=10, least_spread=10, train_end="20240229", test_start="20240301")
    found = []
    for batch in (3, 64):
        done = mining.run(market, wanted, mining.Config(batch=batch, **options), str(tmp_path / f"r{batch}"))
        rows = store.ResultStore(spark, str(tmp_path / f"r{batch}" / "results")).all(done["run_id"])
        found.append(rows.select("canonical", "status", *mining.FIGURES).orderBy("canonical").toPandas())
        assert not files.listing(spark, str(tmp_path / f"r{batch}" / "kept"))
    pd.testing.assert_frame_equal(*found, atol=1e-12)
    again = mining.run(market, wanted, mining.Config(batch=3, **options), str(tmp_path / "r3"))
    assert again["n_resumed"] == 9 and again["n_results"] == 9


@pytest.mark.parametrize("days", [1, 4, 100])
def test_cross_sections_equal_figures_one_by_one(holed, days):  # noqa: F811
    """All figures in one pass over groups of some dates, against a pass each over the long form."""
    _, df = holed
    wide = densify(df, ["x", "y", "close"]).withColumn("fwd", forward_return(5)).withColumn("none", F.lit(None).cast("double"))
    wide = wide.filter("code <> 'c01' or t % 3 > 0")  # codes come and go
    names = ["x", "y", "close", "none"]
    got = metrics.summarise(metrics.cross_sections(wide, names, 9, days=days), 9, "20240020", "20240021", 9).orderBy("expr_id").toPandas()
    long = long_form(wide, names, ["fwd"])
    want = metrics.summary(long, 9, "20240020", "20240021").join(metrics.turnover_proxy(long, 9), "expr_id", "left")
    want = want.join(metrics.quantile_spread(long, least=9), "expr_id", "left").orderBy("expr_id").toPandas()
    assert got.error.isna().all() and got.turnover_proxy.notna().sum() == 3
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False, atol=1e-12)


def test_a_task_holds_one_date_of_a_group():
    """Dates come one by one, whatever the batches; ranks of codes that come and go meet by code."""
    at = lambda t: pa.RecordBatch.from_pydict({"t": pa.array(t, pa.int32()), "code": pa.array([str(i) for i in range(len(t))])})
    batches = iter([at([1, 1, 2]), at([2, 2]), at([]), at([3, 5, 5]), at([5])])
    assert [(d["t"].to_pylist(), d.num_rows) for d in metrics._dates(batches)] == [([1, 1], 2), ([2, 2, 2], 3), ([3], 1), ([5, 5, 5], 3)]
    before, now = (pa.array(["a", "b", "c"]), np.array([0.5, np.nan, 1.0])), (pa.array(["a", "c", "d"]), np.array([0.75, 0.5, 1.0]))
    assert metrics._moved(before, now) == (0.75, 2) and metrics._moved(before, before) == (0.0, 2)


def test_groups_meet_over_groups_without_a_usable_day(spark):
    """Codes that the last usable day does not hold are not taken from a day before it, however groups are cut."""
    values = {1: "abc", 2: "ab", 3: "a", 4: "a", 5: "abd", 6: "bc", 7: "", 8: "cd"}
    rows = [(t, f"{t}", c, float((ord(c) * t * 7) % 11), 0.1) for t, codes in values.items() for c in codes]
    rows = spark.createDataFrame(rows, "t int, trade_date string, code string, x double, fwd double")
    want = metrics.turnover_proxy(long_form(rows, ["x"], ["fwd"]), 2).first().turnover_proxy
    for days in (1, 2, 3, 100):
        found = metrics.cross_sections(rows, ["x"], 2, days=days)
        assert metrics.summarise(found, 2).first().turnover_proxy == pytest.approx(want) and found.count() == 7


def test_the_wide_frame_is_read_once(holed):  # noqa: F811
    _, df = holed
    base = densify(df, ["x", "y", "close"]).withColumn("fwd", forward_return(5))
    planned = mining.plan(["Rank(TsMean($x,10))", "TsStd($y,10)"], mining.Config(fields=("x", "y"), windows=(10,)))
    assert [p.status for p in planned] == ["OK", "OK"]
    plan = plan_of(mining.score(base, planned, mining.Config(least=5)))
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Generate posexplode(array(array") == 1


def failing(x, *_):
    """Fails inside a task, on one row."""
    return F.when(F.col("t") == 9, F.raise_error(F.lit("bad cell"))).otherwise(x)


def test_an_expression_that_fails_in_a_task_is_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(OPS, "Abs", Op("unary", (lambda a, w, p: failing(a[0]),)))
    market = with_features(tables.simulate(spark, 30, 12, seed=3))
    config = mining.Config(windows=(10,), least=5)
    done = mining.run(market, ["Rank($ret_1d)", "Abs($ret_1d)", "Rank($vol_log)", "Inv($vol_log)"], config, str(tmp_path))
    rows = {r.canonical: r for r in store.ResultStore(spark, str(tmp_path / "results")).all(done["run_id"]).collect()}
    assert rows["Abs($ret_1d)"].status.startswith("EVAL_ERROR:") and "bad cell" in rows["Abs($ret_1d)"].status
    assert [r.status for k, r in rows.items() if k != "Abs($ret_1d)"] == ["OK"] * 3 and rows["Abs($ret_1d)"].score is None


def test_an_error_while_scoring_touches_one_expression(holed, monkeypatch):  # noqa: F811
    _, df = holed
    base = densify(df, ["x", "y", "close"]).withColumn("fwd", forward_return(5)).withColumn("x", F.col("x") * 1e300)
    planned = mining.plan(["Mul($x,1)", "Mul($y,1)"], mining.Config(fields=("x", "y")))
    good = metrics._score_day

    def picky(f, *rest):
        if np.nanmax(np.abs(f)) > 1e200:
            raise ArithmeticError("too large")
        return good(f, *rest)

    monkeypatch.setattr(metrics, "_score_day", picky)
    rows = {r.canonical: r for r in mining.score(base, planned, mining.Config(least=5)).collect()}
    if rows["Mul($x,1)"].status != "OK":  # where workers see the patch
        assert rows["Mul($x,1)"].status == "EVAL_ERROR:ArithmeticError:too large" and rows["Mul($x,1)"].coverage is None
    assert rows["Mul($y,1)"].status == "OK" and rows["Mul($y,1)"].usable_days > 0


def test_lost_executors_are_no_failures_of_expressions(spark, tmp_path, monkeypatch):
    from pyspark.errors import PySparkException

    good, calls = mining.score, []

    def flaky(*args):
        calls.append(1)
        if len(calls) <= lose:
            raise PySparkException("Job aborted: ExecutorLostFailure (executor 3 exited)")
        return good(*args)

    monkeypatch.setattr(mining, "score", flaky)
    market = with_features(tables.simulate(spark, 30, 12, seed=3))
    lose = 2
    done = mining.run(market, ["Rank($ret_1d)", "Rank($vol_log)"], mining.Config(windows=(10,), least=5), str(tmp_path / "a"))
    rows = store.ResultStore(spark, str(tmp_path / "a" / "results")).all(done["run_id"]).collect()
    assert [r.status for r in rows] == ["OK", "OK"] and len(calls) == 3
    calls.clear()
    lose = 99
    with pytest.raises(PySparkException, match="ExecutorLost"):
        mining.run(market, ["Rank($ret_1d)"], mining.Config(windows=(10,), least=5), str(tmp_path / "b"))
    assert len(calls) == 1 + mining.RETRIES and not files.listing(spark, str(tmp_path / "b" / "results"))


@pytest.mark.parametrize("w", [65, 100, 101, 250])
def test_wide_windows_against_pandas(spark, w):
    rng = np.random.default_rng(w)
    x = pd.DataFrame({"a": rng.normal(size=700), "b": rng.integers(0, 4, 700).astype(float), "c": np.r_[np.full(300, 2.5), rng.normal(size=400) * 1e6]})
    x.loc[120, "a"] = np.nan
    x.loc[:30, "b"] = np.nan
    rows = [(t + 1, f"{t:08d}", c, None if np.isnan(v) else float(v)) for c in x for t, v in enumerate(x[c])]
    df = spark.createDataFrame(rows, "t int, trade_date string, code string, x double")
    names = {"med": f"TsMed($x,{w})", "rank": f"TsRank($x,{w})", "mad": f"TsMad($x,{w})", "mix": f"TsMean(Sub(TsMed($x,{w}),TsMean($x,{w})),5)"}
    rolled = x.rolling(w, min_periods=w)
    med = rolled.median()
    want = {
        "med": med, "rank": rolled.rank(pct=True), "mad": rolled.apply(lambda a: np.abs(a - a.mean()).mean(), raw=True),
        "mix": (med - rolled.mean()).rolling(5, min_periods=5).mean(),
    }
    for stretch in (None, 90):
        got = evaluate(df, {k: parse(e) for k, e in names.items()}, stretch=stretch).toPandas()
        for k in names:
            table = got.pivot(index="trade_date", columns="code", values=k).to_numpy(float)
            np.testing.assert_allclose(table, want[k].to_numpy(), atol=1e-6, rtol=1e-9, err_msg=k)


def test_a_sliding_window_holds_what_it_should():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, 200).astype(float)
    med, rank, mad = sliding.slide(x, 7, ["median", "rank", "deviation"])
    for i in range(6, 200):
        a = x[i - 6 : i + 1]
        assert med[i] == np.median(a) and rank[i] == pytest.approx(((a < x[i]).sum() + ((a == x[i]).sum() + 1) / 2) / 7)
        assert mad[i] == pytest.approx(np.abs(a - a.mean()).mean())
    assert np.isnan(sliding.slide(np.full(5, np.nan), 2, ["median"])[0]).all() and len(sliding.slide(np.zeros(0), 2, ["rank"])[0]) == 0


@pytest.mark.parametrize("stretch", [1, 7, 44])
def test_histories_in_stretches_equal_whole_ones(holed, stretch):  # noqa: F811
    _, df = holed
    panel = densify(df, ["x", "y", "close"])
    texts = [f"{op}($x,10)" for op, o in OPS.items() if o.kind == "rolling" and not o.endless]
    texts += ["TsCorr($x,$y,10)", "TsCov($x,$y,10)", "TsMean(TsDelta($x,5),5)", "TsMean(Rank(TsMean(TsStd($x,5),5)),5)", "Rank($x)", "Sub(Ref($x,20),$y)"]
    names = {f"e{i}": parse(t) for i, t in enumerate(texts)}
    a, b = (d.orderBy("t", "code").toPandas() for d in (evaluate(panel, names, stretch=stretch), evaluate(panel, names)))
    pd.testing.assert_frame_equal(a, b, atol=1e-9)
    with pytest.raises(ValueError, match="without end"):
        evaluate(panel, {"e": parse("TsEMA($x,10)")}, stretch=stretch)


def test_a_task_holds_a_stretch_and_not_a_history(spark):
    """One code's rows are dealt to many groups."""
    rows = spark.range(1, 2001).select(F.col("id").cast("int").alias("t"), F.format_string("%08d", "id").alias("trade_date"), F.lit("a").alias("code"), F.rand(1).alias("x"))
    out = evaluate(rows, {"m": parse("TsMean($x,10)")}, stretch=100)
    assert "_stretch" in plan_of(out) and out.count() == 2000 and out.filter("m is not null").count() == 1991


def test_ranks_of_a_date_split_over_tasks(spark, tmp_path, holed):  # noqa: F811
    """One date of ties, missing values and one very common value, over eight tasks; and ranks inside windows."""
    rng = np.random.default_rng(2)
    values = [None if i % 11 == 0 else 3.0 if i % 3 else float(rng.integers(0, 50)) for i in range(4000)]
    rows = spark.createDataFrame([(1 + i % 2, f"d{i % 2}" if i < 3990 else "d9", f"c{i:05d}", v) for i, v in enumerate(values)], "t int, trade_date string, code string, x double")
    names = {"a": parse("Rank($x)"), "b": parse("Rank(Mul($x,-1))"), "c": parse("Rank(Abs($x))")}
    got, want = evaluate(rows, names, apart=str(tmp_path)), evaluate(rows, names)
    pd.testing.assert_frame_equal(*(d.orderBy("trade_date", "code").toPandas() for d in (got, want)), atol=1e-12)
    parts = spark.read.parquet(str(next(tmp_path.iterdir()))).filter("trade_date = 'd0' and not _none").select(F.shiftright("_m", 33)).distinct().count()
    assert parts >= 3
    _, df = holed
    panel, names = densify(df, ["x", "y", "close"]), {"v": parse("TsMean(Rank(TsMean($x,5)),5)")}
    pd.testing.assert_frame_equal(*(d.orderBy("t", "code").toPandas() for d in (evaluate(panel, names, apart=str(tmp_path)), evaluate(panel, names))), atol=1e-12)
    assert evaluate(panel.limit(0), names, apart=str(tmp_path)).count() == 0


def test_scores_of_a_date_split_over_tasks(spark, tmp_path, holed):  # noqa: F811
    _, df = holed
    wide = densify(df, ["x", "y", "close"]).withColumn("fwd", forward_return(5))
    long = long_form(wide, ["x", "y"], ["fwd"])
    got, want = (d.orderBy("expr_id", "t").toPandas() for d in (metrics.daily_apart(long, str(tmp_path), 8), metrics.daily(long)))
    pd.testing.assert_frame_equal(got, want[got.columns], atol=1e-12)


def test_the_store_is_one_file_a_run_after_compaction(spark, tmp_path):
    s = store.ResultStore(spark, str(tmp_path / "r"))
    row = "run_id string, canonical string, score double"
    for i in range(10):
        s.upsert(spark.createDataFrame([("r1", f"k{j}", float(i)) for j in range(i + 1)] + [("r2", "z", float(i))], row))
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(sorted((r.canonical, r.score) for r in s.all("r1").collect()))

    reader = threading.Thread(target=read)
    reader.start()
    s.compact("r1")
    stop.set()
    reader.join()
    assert len(s.files("r1")) == 1 and len(files.listing(spark, s.files("r1")[0])) == 1
    want = sorted((f"k{j}", 9.0) for j in range(10))
    assert seen and all(x == want for x in seen) and sorted((r.canonical, r.score) for r in s.all("r1").collect()) == want
    s.upsert(spark.createDataFrame([("r1", "k0", -1.0), ("r1", "new", 5.0)], row))
    assert len(s.files("r1")) > 1 and {r.canonical: r.score for r in s.all("r1").collect()}["k0"] == -1.0
    for _ in range(3):
        s.compact("r1")
        s.upsert(spark.createDataFrame([("r1", "k1", 7.0)], row))
        s.compact("r1")
    assert s.all("r1").count() == 11 and len(s.files("r1")) == 1 and s.all("r2").count() == 1
    assert len(files.listing(spark, str(tmp_path / "r" / "base" / "run_id=r1"))) <= 2
    wanted = spark.createDataFrame([("k1",), ("other",)], "canonical string")
    assert [r.canonical for r in s.remaining("r1", wanted).collect()] == ["other"] and s.remaining("none", wanted).count() == 2


def test_a_stateful_load_takes_a_row_once_and_names_what_is_late(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "k string, v int, at timestamp"
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.follow_once(spark, src, schema, out, ck, ["k", "v", "at"], "at", "3 days").awaitTermination()
        return sorted((r.k, r.v) for r in spark.read.schema(schema).parquet(out + "/batch=*").collect())

    assert arrive([("a", 1, at(10)), ("b", 1, at(10)), ("a", 1, at(10))]) == [("a", 1), ("b", 1)]
    # The same rows under another file name, a later version, a new key.
    assert arrive([("a", 1, at(10)), ("a", 2, at(11)), ("c", 1, at(12))]) == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]
    # Two days before the newest: in time. The watermark then stands at the 27th.
    assert ("d", 1) in arrive([("d", 1, at(10, 1)), ("e", 1, at(30))])
    # The 5th is late: it stays out, is listed, and is not lost.
    assert arrive([("f", 1, at(5)), ("g", 1, at(29))]) == [("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1), ("e", 1), ("g", 1)]
    loaded, arrived = spark.read.schema(schema).parquet(out + "/batch=*"), spark.read.schema(schema).parquet(src)
    assert [(r.k, r.v) for r in incremental.late(arrived, loaded, ["k", "v", "at"]).collect()] == [("f", 1)]
    assert {(r.k, r.v) for r in incremental.newest(loaded, ["k"], "v").collect()} >= {("a", 2), ("g", 1)}


def test_alpha_beta_and_turnover_against_numpy(holed):  # noqa: F811
    _, df = holed
    panel = densify(df, ["x", "close"]).withColumn("f", F.col("x"))
    cleaned = diagnostics.clean_factor(panel, (1, 5))
    c = cleaned.toPandas()
    got = {r.period: r for r in diagnostics.alpha_beta(cleaned).collect()}
    for p in (1, 5):
        xy = []
        for _, d in c.groupby("trade_date"):
            w = d.factor - d.factor.mean()
            if w.abs().sum() > 0:
                xy.append((d[f"period_{p}"].mean(), (w * d[f"period_{p}"]).sum() / w.abs().sum()))
        x, y = np.array(xy).T
        beta, alpha = np.polyfit(x, y, 1)
        r = got[f"period_{p}"]
        assert r.n_dates == len(x) and r.beta == pytest.approx(beta) and r.alpha == pytest.approx(alpha) and r.ann_alpha == pytest.approx((1 + alpha) ** (252 / p) - 1)
    held = {d: {q: set(g.code) for q, g in day.groupby("factor_quantile")} for d, day in c.groupby("trade_date")}
    dates = sorted(held)
    turned = {(r.trade_date, r.factor_quantile): r for r in diagnostics.quantile_turnover(cleaned, 2).collect()}
    assert len(turned) == sum(map(len, held.values()))
    for i, d in enumerate(dates):
        for q, codes in held[d].items():
            r = turned[d, q]
            assert r.n == len(codes)
            assert r.turnover is None if i < 2 else r.turnover == pytest.approx(len(codes - held[dates[i - 2]].get(q, set())) / len(codes))
    assert diagnostics.alpha_beta(cleaned.limit(0)).count() == 0 and diagnostics.quantile_turnover(cleaned.limit(0)).count() == 0


def test_a_yearly_loss_of_nearly_all_still_has_a_log(spark):
    # The market earns 1 and 3 %, the portfolio -70 and -78 % a date: alpha -0.66, of which a year leaves less than a double tells from -1.
    rows = [(d, c, f, m + s * p) for d, m, p in (("20240101", 0.01, -0.70), ("20240102", 0.03, -0.78)) for c, f, s in (("a", 2.0, 1), ("b", 1.0, -1))]
    r = diagnostics.alpha_beta(spark.createDataFrame(rows, "trade_date string, code string, factor double, period_5 double")).first()
    assert r.alpha == pytest.approx(-0.66) and r.beta == pytest.approx(-4) and r.ann_alpha == -1
    assert r.log_ann == pytest.approx(252 / 5 * np.log(0.34))


def test_many_frames_in_batches_equal_windows_of_spark(spark, holed, monkeypatch):  # noqa: F811
    """The same doubles both ways, over batches that cut histories, windows of windows, and holes."""
    _, df = holed
    base = densify(df, ["x", "y", "close"])
    single = [op for op, o in OPS.items() if o.windowed and o.kind == "rolling"]
    texts = [f"{op}(${c},5)" for op in single for c in ("x", "y")] + ["TsCorr($x,$y,6)", "TsCov($y,$close,5)", "TsCorr($y,$x,3)"]
    texts += ["TsMean(TsStd($x,3),4)", "Rank(TsCov($x,$y,5))", "TsMax(Rank(TsMean($x,3)),4)", "Rank(TsMean($y,4))", "Rank(TsIr($y,4))"]
    nodes = {f"v{i}": parse(t) for i, t in enumerate(texts)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        many = evaluate(base, nodes)
        assert "MapInArrow" in plan_of(many)
        got = many.orderBy("code", "t").toPandas()
        monkeypatch.setattr(frames, "FEW", 10**6)
        few = evaluate(base, nodes)
        assert "MapInArrow" not in plan_of(few)
        pd.testing.assert_frame_equal(got, few.orderBy("code", "t").toPandas(), check_exact=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(got[c].notna().any() for c in nodes) == len(nodes)


def test_features_hold_what_the_runs_read():
    assert {"ret_1d", "vol_log"} <= set(PUBLIC)


def test_a_panel_of_items_is_dealt_by_code_once(spark):
    base = mining.base_panel(with_features(adapters.bars(spark, "/root/testdata/sf0.001")), mining.Config())
    plan = plan_of(evaluate(base, {"e": parse("TsEMA($ret_1d,10)"), "m": parse("TsMean($vol_log,10)")}, ["fwd"]))
    # Once for the panel; its list of dates stands twice in the plan.
    assert plan.count("Exchange hashpartitioning(code") == 3 and "NestedLoop" not in plan and "SortMergeJoin" not in plan


def test_cells_of_facts_that_stand_twice_or_have_no_key(spark):
    rows = [("a", "2", 1.0), ("a", "2", 2.0), ("a", "4", 3.0), ("b", "3", 4.0), (None, "3", 5.0), (None, "3", 6.0), ("c", None, 7.0)]
    df = spark.createDataFrame(rows, "code string, trade_date string, x double")
    got = densify(df, ["x"])
    days, codes = df.select("trade_date").distinct().collect(), df.select("code").distinct().collect()
    numbered = {d: i for i, d in enumerate(sorted((r[0] for r in days), key=lambda d: d or ""), 1)}
    want = [
        (numbered[d], d, c, x)
        for (d,) in days
        for (c,) in codes
        for x in ([r[2] for r in rows if r[:2] == (c, d) and None not in r[:2]] or [None])
    ]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr) and got.columns == ["t", "trade_date", "code", "x"]


def test_a_value_of_frames_comes_back_as_one_column(spark, holed, monkeypatch):  # noqa: F811
    monkeypatch.setattr(frames, "FEW", 0)
    plan = plan_of(evaluate(densify(holed[1], ["x", "y"]), {"c": parse("TsCorr($x,$y,6)"), "m": parse("TsMean($x,5)")}))
    read, told = re.search(r"MapInArrow run\((.*?)\)#\d+L?, \[(.*?)\]", plan).groups()
    assert len(told.split(",")) == len(read.split(",")) + 2
