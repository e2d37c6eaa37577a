"""Scores of expressions against forward returns. Input is the long frame (expr_id, t, trade_date, code, f, fwd)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfactor.operators.ranks import rank_apart

DAY = ["expr_id", "t", "trade_date"]


def _paired(long: DataFrame) -> DataFrame:
    return long.filter(F.col("f").isNotNull() & F.col("fwd").isNotNull())


def _ordinal(x: str, *more: str) -> Column:
    return F.row_number().over(Window.partitionBy(*DAY).orderBy(x, *more)).cast("double")


def daily(long: DataFrame, ranks: str = "ordinal") -> DataFrame:
    """(expr_id, t, trade_date, cells, n, pairs, ic, rank_ic) of every day, in one pass over the long frame: both
    ranks and the sums share one exchange. Ordinal ranks break ties by code and ask for some spread; average ranks
    share ties and only need it not to be zero."""
    ok = F.col("f").isNotNull() & F.col("fwd").isNotNull()
    rows = long.withColumn("ok", ok)
    same = Window.partitionBy(*DAY, "ok")
    if ranks == "ordinal":
        rank = lambda x: F.row_number().over(same.orderBy(x, "code")).cast("double")
    else:
        rank = lambda x: F.rank().over(same.orderBy(x)) + (F.count("*").over(Window.partitionBy(*DAY, "ok", x)) - 1) / F.lit(2.0)
    rows = rows.withColumns({"rf": rank("f"), "rr": rank("fwd")})
    n = F.count_if("ok")

    def corr(x: str, y: str) -> Column:
        a, b = F.when(F.col("ok"), F.col(x)), F.when(F.col("ok"), F.col(y))
        spread = F.stddev_pop(a) * F.stddev_pop(b)
        enough = n * spread > 1e-10 if ranks == "ordinal" else spread > 0
        return F.when((n >= 10) & enough, F.covar_pop(a, b) / spread)

    return rows.groupBy(*DAY).agg(
        F.count("*").alias("cells"), F.count("f").alias("n"), n.alias("pairs"), corr("f", "fwd").alias("ic"), corr("rf", "rr").alias("rank_ic")
    )


def daily_apart(long: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """daily() with ordinal ranks, for dates of more codes than a task should hold: ranks are sorted over many tasks, and
    what is left are sums, which are added up where the rows lie."""
    ids, ok = ["expr_id", "t", "trade_date"], F.col("f").isNotNull() & F.col("fwd").isNotNull()
    ranked = rank_apart(long.filter(ok), {"rf": F.col("f"), "rr": F.col("fwd")}, [*ids, "code", "f", "fwd"], folder, parts, tuple(ids))
    n = F.count("*")

    def corr(x: str, y: str, scale: Column) -> Column:
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.when((n >= 10) & (n * spread * scale * scale > 1e-10), F.covar_pop(x, y) / spread)

    # Percentiles are places over n.
    paired = ranked.groupBy(*ids).agg(n.alias("_pairs"), corr("f", "fwd", F.lit(1.0)).alias("ic"), corr("rf", "rr", n).alias("rank_ic"))
    sizes = long.groupBy(*ids).agg(n.alias("cells"), F.count("f").alias("n"))
    out = sizes.join(paired, ids, "left")
    return out.select(*ids, "cells", "n", F.coalesce("_pairs", F.lit(0).cast("long")).alias("pairs"), "ic", "rank_ic")


def cells(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles, NaN where missing."""
    return column.combine_chunks().to_numpy(zero_copy_only=False).astype(float)


def percentiles(x: np.ndarray) -> np.ndarray:
    """Ordinal percentiles of the values of one date, ties in the order of the rows; NaN where missing."""
    order = np.argsort(x, kind="stable")  # NaN last
    n = int((~np.isnan(x)).sum())
    out = np.full(len(x), np.nan)
    out[order[:n]] = np.arange(1, n + 1) / max(n, 1)
    return out


def _correlation(x: np.ndarray, y: np.ndarray) -> float:
    """As corr() in daily() for ordinal ranks."""
    if len(x) < 10:
        return np.nan
    a, b = x - x.mean(), y - y.mean()
    spread = np.sqrt((a * a).mean()) * np.sqrt((b * b).mean())
    return (a * b).mean() / spread if len(x) * spread > 1e-10 else np.nan


#: Expressions that are scored together for a date.
BLOCK = 16


def daily_of_many(wide: DataFrame, names: list[str]) -> DataFrame:
    """daily() of a wide frame (t, trade_date, code, fwd, one column for each expression) with ordinal ranks. In long form
    each expression would sort every date twice; here a date's cross-section of some expressions is one Arrow table, and
    the returns are sorted once for them. A cross-section is the codes listed on a date."""
    blocks = [names[i : i + BLOCK] for i in range(0, len(names), BLOCK)]
    pad = lambda b: F.array(*[F.col(c) for c in b], *[F.lit(None).cast("double")] * (BLOCK - len(b)))
    rows = wide.select("t", "trade_date", "code", "fwd", F.posexplode(F.array(*[pad(b) for b in blocks])).alias("b", "x"))

    def score(key: tuple, table: pa.Table) -> pa.Table:
        t, day, b = (k.as_py() for k in key)
        table = table.take(pc.sort_indices(table["code"]))
        fwd, x = cells(table["fwd"]), cells(pa.chunked_array([table["x"].combine_chunks().flatten()])).reshape(-1, BLOCK)
        by_return, priced = np.argsort(fwd, kind="stable"), ~np.isnan(fwd)
        out = []
        for i, name in enumerate(blocks[b]):
            f = x[:, i]
            known = ~np.isnan(f)
            ok = known & priced
            pairs = int(ok.sum())
            ic, rank_ic = _correlation(f[ok], fwd[ok]), np.nan
            if pairs >= 10:
                places = np.empty((2, len(f)))
                for k, order in enumerate((np.argsort(f, kind="stable"), by_return)):
                    places[k, order[ok[order]]] = np.arange(1, pairs + 1)
                rank_ic = _correlation(places[0, ok], places[1, ok])
            out.append((name, t, day, len(f), int(known.sum()), pairs, ic, rank_ic))
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k, from_pandas=True) for c, k in zip(zip(*out), kinds)], [*DAY, "cells", "n", "pairs", "ic", "rank_ic"])

    return rows.groupBy("t", "trade_date", "b").applyInArrow(
        score, "expr_id string, t int, trade_date string, cells long, n long, pairs long, ic double, rank_ic double"
    )


#: Dates of one group of cross-sections.
DAYS = 16
#: A row of a group: the figures of an expression on a date, its error, or (with a code) the rank percentile of a code on the first
#: or last usable date of the group.
_ROW = pa.schema(
    [("e", pa.int32()), ("g", pa.int64()), ("t", pa.int32()), ("trade_date", pa.string())]
    + [(c, pa.int64()) for c in ("cells", "n", "pairs")]
    + [(c, pa.float64()) for c in ("ic", "rank_ic", "spread", "moved")]
    + [("moves", pa.int64()), ("usable", pa.bool_()), ("error", pa.string()), ("code", pa.string()), ("rank", pa.float64()), ("last", pa.bool_())]
)
_ROW_DDL = (
    "e int, g long, t int, trade_date string, cells long, n long, pairs long, ic double, rank_ic double, spread double, moved double, "
    "moves long, usable boolean, error string, code string, rank double, last boolean"
)


def _moved(before: tuple[pa.Array, np.ndarray], now: tuple[pa.Array, np.ndarray]) -> tuple[float, int]:
    """(sum of absolute changes, codes) of two vectors (codes, rank percentiles, NaN where missing)."""
    if before[0].equals(now[0]):
        change = np.abs(now[1] - before[1])
    else:
        at = pc.index_in(now[0], value_set=before[0]).fill_null(len(before[0])).to_numpy(zero_copy_only=False)
        change = np.abs(now[1] - np.append(before[1], np.nan)[at])
    change = change[~np.isnan(change)]
    return float(change.sum()), len(change)


def _dates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each date in turn, of batches in the order of t."""
    held, now = [], None
    for batch in batches:
        t = batch["t"].to_numpy()
        cuts = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)] if len(t) else []
        for i, j in zip(cuts, cuts[1:]):
            if held and t[i] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = t[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _rows(n: int, **columns: object) -> pa.RecordBatch:
    """n rows of a group; a column is an array, a value of all rows, or missing."""
    full = lambda v, k: v if isinstance(v, pa.Array) else pa.nulls(n, k) if v is None else pa.repeat(pa.scalar(v, k), n)
    return pa.RecordBatch.from_arrays([full(columns.get(f.name), f.type) for f in _ROW], schema=_ROW)


def _score_day(f: np.ndarray, fwd: np.ndarray, order: np.ndarray, by_return: np.ndarray, q: int) -> tuple:
    """(values, pairs, ic, rank_ic, spread) of one expression on one date; rows in the order of the code."""
    known = ~np.isnan(f)
    ok = known & ~np.isnan(fwd)
    pairs = int(ok.sum())
    if not pairs:
        return int(known.sum()), 0, np.nan, np.nan, np.nan
    places = np.empty((2, len(f)))
    for k, by in enumerate((order, by_return)):
        places[k, by[ok[by]]] = np.arange(1, pairs + 1)
    share, returns = places[0, ok] / pairs, fwd[ok]
    top, low = returns[share >= 1 - 1 / q], returns[share <= 1 / q]
    spread = top.mean() - low.mean() if len(top) and len(low) else np.nan
    return int(known.sum()), pairs, _correlation(f[ok], returns), _correlation(places[0, ok], places[1, ok]), spread


def cross_sections(wide: DataFrame, names: list[str], least: int, q: int = 5, days: int = DAYS) -> DataFrame:
    """All daily figures of a wide frame (t, trade_date, code, fwd, one column for each expression), which is read once:
    (expr_id, t, trade_date, cells, n, pairs, ic, rank_ic, spread, moved, moves, error). moved is the sum of absolute changes
    of rank percentiles since the last usable day (one with at least ``least`` values) over the codes valued on both, moves
    their number.

    A group is some dates in order and a block of expressions. Its rows come in the order of date and code, and a task holds one date
    of them and, of each expression, the rank vector of the last usable day, which is carried from date to date. Groups meet
    at their edges by code: the ranks on the first and last usable day of a group are rows like any other, dealt by
    expression and code. An expression whose figures cannot be computed gives a row with the error, and the others are not touched.
    """
    width = min(BLOCK, max(len(names), 1))
    blocks = [names[i : i + width] for i in range(0, len(names), width)]
    pad = lambda b: F.array(*[F.col(c).cast("double") for c in b], *[F.lit(None).cast("double")] * (width - len(b)))
    rows = wide.select("t", "trade_date", "code", "fwd", F.floor(F.col("t") / days).alias("g"), F.posexplode(F.array(*[pad(b) for b in blocks])).alias("b", "x"))
    placed = rows.repartition("g", "b").sortWithinPartitions("g", "b", "t", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, failed, reached = {}, set(), None
        for table in _dates(batches):
            t, g, b = (table[c][0].as_py() for c in ("t", "g", "b"))
            if reached is not None and t <= reached:
                raise ValueError("rows of a group are out of order")
            date, codes, fwd = table["trade_date"][0].as_py(), table["code"].combine_chunks(), cells(table["fwd"])
            x = cells(pa.chunked_array([table["x"].combine_chunks().flatten()])).reshape(-1, width)
            by_return, said, reached = np.argsort(fwd, kind="stable"), [], t
            for i, _ in enumerate(blocks[b]):
                e = b * width + i
                if e in failed:
                    continue
                try:
                    figures, ranks = _score_date(np.ascontiguousarray(x[:, i]), fwd, by_return)
                    moved, moves = _moved(before[e], (codes, ranks)) if ranks is not None and e in before else (None, 0)
                except Exception as error:  # noqa: BLE001 - the row says what happened
                    failed.add(e)
                    before.pop(e, None)
                    said.append({"e": e, "g": g, "error": f"{type(error).__name__}:{error}"})
                    continue
                said.append(dict(e=e, g=g, t=t, trade_date=date, cells=len(fwd), **figures, moved=moved, moves=moves, usable=ranks is not None))
                if ranks is not None:
                    if e not in before:
                        yield edge(e, g, t, codes, ranks, False)
                    before[e] = codes, ranks
            if said:
                yield pa.RecordBatch.from_pylist(said, schema=_ROW)
        for e, (codes, ranks) in before.items():
            yield edge(e, g, None, codes, ranks, True)

    def edge(e: int, g: int, t: int | None, codes: pa.Array, ranks: np.ndarray, last: bool) -> pa.RecordBatch:
        known = ~np.isnan(ranks)
        return _rows(int(known.sum()), e=e, g=g, t=t, code=codes.filter(pa.array(known)), rank=pa.array(ranks[known]), last=last)

    def _score_date(f: np.ndarray, fwd: np.ndarray, by_return: np.ndarray) -> tuple[dict, np.ndarray | None]:
        order, ranks = np.argsort(f, kind="stable"), None
        n, pairs, *floats = _score_day(f, fwd, order, by_return, q)
        if n >= least:
            ranks = np.full(len(f), np.nan)
            ranks[order[:n]] = np.arange(1, n + 1) / n
        floats = [None if np.isnan(v) else float(v) for v in floats]
        return dict(zip(("n", "pairs", "ic", "rank_ic", "spread"), (n, pairs, *floats))), ranks

    found = placed.groupBy("g", "b").applyInArrow(run, _ROW_DDL)
    own = Window.partitionBy("e", "code").orderBy("g", "last")
    at_edge = F.col("code").isNotNull()
    meets = at_edge & ~F.col("last") & F.lag("last").over(own)
    met = found.withColumns({"_from": F.when(meets, F.lag("g").over(own)), "_change": F.when(meets, F.abs(F.col("rank") - F.lag("rank").over(own)))})
    met = met.filter(~at_edge | F.col("_from").isNotNull())
    figures = ["trade_date", "cells", "n", "pairs", "ic", "rank_ic", "spread"]
    # A row an expression and date, and one for each group that codes come from to a first usable date.
    sums = met.groupBy("e", "g", "t", "_from").agg(
        *[F.max(c).alias(c) for c in (*figures, "usable")],
        F.sum(F.coalesce("moved", "_change")).alias("moved"),
        F.sum(F.coalesce("moves", F.when(F.col("_change").isNotNull(), 1), F.lit(0))).alias("moves"),
        F.min("error").alias("error"),
    )
    # Only the last group with a usable date counts.
    earlier = Window.partitionBy("e").orderBy("t", F.col("_from").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    near = F.col("_from").isNull() | (F.col("_from") == F.last(F.when(F.col("usable"), F.col("g")), ignorenulls=True).over(earlier))
    days_of = sums.withColumn("_near", near).filter("_near").groupBy("e", "t").agg(
        *[F.max(c).alias(c) for c in figures], F.sum("moved").alias("moved"), F.sum("moves").alias("moves"), F.min("error").alias("error")
    )
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("e") + 1).alias("expr_id")
    return days_of.select(name, "t", *figures, "moved", "moves", "error")


def daily_ic(long: DataFrame, ranks: str = "ordinal") -> DataFrame:
    """(expr_id, t, trade_date, ic, rank_ic) of the days with pairs."""
    return daily(long, ranks).filter("pairs > 0").select(*DAY, "ic", "rank_ic")


def usable_days(long: DataFrame, least: int) -> DataFrame:
    """Days on which an expression has at least ``least`` values, numbered by u."""
    days = long.groupBy(*DAY).agg(F.count("f").alias("n")).filter(F.col("n") >= least)
    return days.withColumn("u", F.row_number().over(Window.partitionBy("expr_id").orderBy("t")))


def _ratio(mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, mean / sd)


def summary(long: DataFrame, least: int = 30, train_end: str | None = None, test_start: str | None = None, ranks: str = "ordinal") -> DataFrame:
    """One row per expression: coverage, usable days, IC and rank IC with their ratios, for all days and for the
    training and test days, and the score."""
    return summarise(daily(long, ranks), least, train_end, test_start)


def summarise(days: DataFrame, least: int = 30, train_end: str | None = None, test_start: str | None = None, least_spread: int = 50) -> DataFrame:
    """summary() of the rows of daily(), daily_of_many() or cross_sections(). Those of the last have turnover_proxy and
    quantile_spread too (of days with ``least_spread`` pairs), and the first error of an expression."""
    usable = F.col("n") >= least
    train = F.col("trade_date") <= F.lit(train_end) if train_end else F.lit(False)
    test = F.col("trade_date") >= F.lit(test_start) if test_start else F.lit(False)
    r, ic = F.when(usable, F.col("rank_ic")), F.when(usable, F.col("ic"))
    stats = days.groupBy("expr_id").agg(
        (F.sum("n") / F.sum("cells")).alias("coverage"),
        F.count_if(usable).alias("usable_days"),
        F.avg(ic).alias("mean_ic"),
        _ratio(F.avg(ic), F.stddev_pop(ic)).alias("icir"),
        F.avg(r).alias("mean_rank_ic"),
        _ratio(F.avg(r), F.stddev_pop(r)).alias("rank_icir"),
        F.avg(F.when(usable, F.when(r > 0, 1.0).otherwise(0.0))).alias("positive_rank_ic_ratio"),
        *[
            x
            for name, mask in (("train", train), ("test", test))
            for v in [F.when(mask, r)]
            for x in (F.avg(v).alias(f"{name}_mean_rank_ic"), _ratio(F.avg(v), F.stddev_pop(v)).alias(f"{name}_rank_icir"))
        ],
        *(
            [
                (F.sum("moved") / F.sum("moves")).alias("turnover_proxy"),
                F.avg(F.when(F.col("pairs") >= least_spread, F.col("spread"))).alias("quantile_spread"),
                F.min("error").alias("error"),
            ]
            if "moved" in days.columns
            else []
        ),
    )
    agree = F.when(F.col("train_mean_rank_ic") * F.col("test_mean_rank_ic") > 0, 1.0).otherwise(0.25)
    score = F.when(
        F.col("train_mean_rank_ic").isNotNull() & F.col("test_mean_rank_ic").isNotNull(),
        F.abs("test_mean_rank_ic") * F.abs("test_rank_icir") * agree,
    )
    return stats.withColumn("score", score)


def year_rank_ic(long: DataFrame, least: int = 30) -> DataFrame:
    days = daily(long).filter(F.col("n") >= least)
    return days.groupBy("expr_id", F.substring("trade_date", 1, 4).alias("year")).agg(F.avg("rank_ic").alias("rank_ic"))


def turnover_proxy(long: DataFrame, least: int = 30) -> DataFrame:
    """Mean absolute change of a code's rank percentile between consecutive usable days."""
    same = Window.partitionBy(*DAY)
    days = usable_days(long, least).select("expr_id", "t", "u")
    ranked = long.filter(F.col("f").isNotNull()).withColumn("rk", _ordinal("f", "code") / F.count("*").over(same)).join(days, ["expr_id", "t"])
    own = Window.partitionBy("expr_id", "code").orderBy("u")
    near = ranked.withColumns({"before": F.lag("rk").over(own), "ub": F.lag("u").over(own)})
    moved = F.when(F.col("ub") == F.col("u") - 1, F.abs(F.col("rk") - F.col("before")))
    return near.groupBy("expr_id").agg(F.avg(moved).alias("turnover_proxy"))


def quantile_spread(long: DataFrame, q: int = 5, least: int = 50) -> DataFrame:
    """Mean over days of the mean return of the top less that of the bottom quantile, by ordinal rank percentile."""
    ranked = _paired(long).withColumn("rk", _ordinal("f", "code") / F.count("*").over(Window.partitionBy(*DAY)))
    top, low = F.avg(F.when(F.col("rk") >= 1 - 1 / q, F.col("fwd"))), F.avg(F.when(F.col("rk") <= 1 / q, F.col("fwd")))
    days = ranked.groupBy(*DAY).agg((top - low).alias("spread"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return days.groupBy("expr_id").agg(F.avg("spread").alias("quantile_spread"))


def rolling_ic(long: DataFrame, windows: tuple[int, ...] = (20, 60, 120), ranks: str = "average") -> DataFrame:
    """Rank IC of each day with its mean over the w days before it, if half of them have one."""
    return rolling_ic_of(daily(long, ranks), windows)


def rolling_ic_of(days: DataFrame, windows: tuple[int, ...] = (20, 60, 120)) -> DataFrame:
    """rolling_ic() of the rows of daily()."""
    days = days.select(*DAY, "rank_ic")
    order = Window.partitionBy("expr_id").orderBy("t")
    cols = {}
    for w in windows:
        back = order.rowsBetween(-w, -1)
        enough = (F.row_number().over(order) > w) & (F.count("rank_ic").over(back) >= w // 2)
        cols[f"rolling_{w}_rank_ic"] = F.when(enough, F.avg("rank_ic").over(back))
    return days.withColumns(cols)
