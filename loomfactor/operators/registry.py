"""Operators of the expression language: name -> how a column is built from its arguments.

A new operator is one entry. ``row`` operators are local to a row. ``window`` operators need a pass of their own
(or several) over windows of a code's rows, or of a date's for Rank; passes at the same depth share one sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfactor.functions.missing import safe_div
from loomfactor.operators import frames
from loomfactor.operators.panel import by_code


class Pass:
    """What a builder gets beside its arguments: the columns of earlier passes, hold(), which names a window column that is
    built once and may be used, here and by other operators on the same arguments, any number of times, and the rows of the
    code around a row: of its whole history, or of the stretch of it that a task holds. framed() is hold() for a statistic of the
    last rows that operators/frames.py knows too; told() says that the whole value is one, by its name there."""

    def __init__(
        self, hold: Callable[[str, Column], Column], earlier: list[Column], keys: tuple[str, ...] = ("code",), framed: Callable[[str, Column], Column] | None = None,
        told: Callable[[str], None] = lambda stat: None,
    ):
        self.hold, self.earlier, self.keys, self.framed, self.told = hold, earlier, keys, framed or hold, told

    def own(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy("t")

    def frame(self, w: int) -> Window:
        return self.own().rowsBetween(-(w - 1), 0)


@dataclass(frozen=True)
class Op:
    kind: str  # unary, binary, rolling or pair
    #: One builder for each pass: (arguments, window, Pass) -> Column.
    passes: tuple[Callable[..., Column], ...]
    windowed: bool = False
    #: Whether a value depends on all rows before it, however far back.
    endless: bool = False
    #: Name of the statistic of ordered values that serves wide windows (see operators/sliding.py).
    ordered: str | None = None

    @property
    def arity(self) -> int:
        return {"unary": 1, "binary": 2, "rolling": 2, "pair": 3}[self.kind]


def _both(f: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda a, w, p: F.when(a[0].isNotNull() & a[1].isNotNull(), f(a[0], a[1]))


def _row(kind: str, f: Callable[..., Column]) -> Op:
    return Op(kind, (lambda a, w, p: f(*a),))


def _stat(stat: str, x: Column, w: int, p: Pass) -> Column:
    f = STATS[stat]
    return (p.framed if stat in frames.SINGLE else p.hold)(stat, f(x).over(p.frame(w)))


#: Statistics of a frame that operators share.
STATS: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "mean": F.avg,
    "sum": F.sum,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "max": F.max,
    "min": F.min,
    "median": lambda x: F.percentile(x, F.lit(0.5)),
    "skewness": F.skewness,
    "kurtosis": F.kurtosis,
    "list": F.collect_list,
}


def _full(agg: Callable[[Column, int, Pass], Column], ordered: str | None = None) -> Op:
    """A statistic of a frame in which all w rows have a value."""
    return Op("rolling", (lambda a, w, p: F.when(_stat("count", a[0], w, p) == w, agg(a[0], w, p)),), True, ordered=ordered)


def _over(stat: str) -> Op:
    def agg(x: Column, w: int, p: Pass) -> Column:
        p.told(f"full {stat}")
        return _stat(stat, x, w, p)

    return _full(agg)


def rank_of(x: Column) -> Column:
    """Ordinal percentile among the date's values, ties in the order of the code."""
    same = Window.partitionBy("trade_date", x.isNull())
    return F.when(x.isNotNull(), F.row_number().over(same.orderBy(x, "code")) / F.count("*").over(same))


def _ts_rank(x: Column, w: int, p: Pass) -> Column:
    values = _stat("list", x, w, p)
    below, equal = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
    return (below + (equal + 1) / F.lit(2.0)) / F.lit(float(w))


def _ts_mad(x: Column, w: int, p: Pass) -> Column:
    values, mean = _stat("list", x, w, p), _stat("mean", x, w, p)
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - mean)) / F.lit(float(w))


def _ts_wma(x: Column, w: int, p: Pass) -> Column:
    t = F.col("t").cast("double")
    weighted = p.framed("sum of t x", F.sum(t * x).over(p.frame(w)))
    return (weighted - (t - w) * _stat("sum", x, w, p)) / F.lit(w * (w + 1) / 2)


def _ts_skew(x: Column, w: int, p: Pass) -> Column:
    return F.coalesce(_stat("skewness", x, w, p) * F.lit(sqrt(w * (w - 1)) / (w - 2)), F.lit(0.0))


def _ts_kurt(x: Column, w: int, p: Pass) -> Column:
    raw = ((w + 1) * _stat("kurtosis", x, w, p) + 6) * F.lit((w - 1) / ((w - 2) * (w - 3)))
    return F.coalesce(raw, F.lit(-3.0))


def _so_far(at: int = 0) -> Window:
    return by_code().rowsBetween(Window.unboundedPreceding, at)


#: Weights of the moving average are kept as exponents; a code's rows are cut into stretches over which the weight of the
#: oldest value falls by no more than this exponent, so that nothing overflows however long the panel is.
STRETCH = 500.0


def _ema_decay(a, w, p) -> Column:
    """Log of the weight that older values keep at an observation: (1-alpha)^gap against the new value's alpha."""
    alpha = 2.0 / (w + 1)
    before = p.hold("last t", F.last(F.when(a[0].isNotNull(), F.col("t")), ignorenulls=True).over(_so_far(-1)))
    fall = (F.col("t") - before).cast("double") * F.lit(log(1 - alpha))
    return F.when(a[0].isNotNull(), F.coalesce(fall - F.ln(F.exp(fall) + alpha), F.lit(0.0)))


def _ema_level(a, w, p) -> Column:
    return p.hold("log weight", F.sum(p.earlier[0]).over(_so_far()))


def _stretch(level: Column) -> Column:
    return F.floor(-level / STRETCH)


def _in_stretch(level: Column) -> Column:
    """The level since the start of its stretch."""
    return level + STRETCH * _stretch(level)


def _ema_local(a, w, p) -> Column:
    """The average of the values of the own stretch alone, at the weights they have in the whole."""
    decay, level = p.earlier
    # The first observation has decay 0 and no older value to share with: its weight is 1.
    weight = F.when(decay == 0, 1.0).otherwise(1 - F.exp(decay))
    own = Window.partitionBy("code", _stretch(level)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return F.exp(_in_stretch(level)) * p.hold("weighted", F.sum(weight * a[0] * F.exp(-_in_stretch(level))).over(own))


def _ema_end(a, w, p) -> Column:
    """The local average at the last row of a stretch."""
    _, level, local = p.earlier
    after = p.hold("next stretch", F.lead(_stretch(level)).over(Window.partitionBy("code").orderBy(_stretch(level), "t")))
    return F.when(after > _stretch(level), local)


def _ema(a, w, p) -> Column:
    """Values older than the stretch before have lost all weight: e^-500 is beyond the precision of a double."""
    _, level, local, end = p.earlier
    past = Window.partitionBy("code").orderBy(_stretch(level), "t").rowsBetween(Window.unboundedPreceding, -1)
    older = p.hold("older", F.last(F.when(end.isNotNull(), F.struct(end.alias("y"), level.alias("l"))), ignorenulls=True).over(past))
    value = local + F.coalesce(F.exp(level - older["l"]) * older["y"], F.lit(0.0))
    return F.when(p.hold("seen", F.count(a[0]).over(_so_far())) >= w, value)


def _pairs(a: list[Column]) -> tuple[Column, Column]:
    ok = a[0].isNotNull() & a[1].isNotNull()
    return F.when(ok, a[0]), F.when(ok, a[1])


def _ts_cov(a, w, p) -> Column:
    x, y = _pairs(a)
    n = p.framed("pairs", F.count(x).over(p.frame(w)))
    return F.when(n == w, p.framed("covariance", F.covar_samp(x, y).over(p.frame(w))))


def _ts_corr(a, w, p) -> Column:
    x, y = _pairs(a)
    n = p.framed("pairs", F.count(x).over(p.frame(w)))
    spread = p.framed("std x", F.stddev_pop(x).over(p.frame(w))) * p.framed("std y", F.stddev_pop(y).over(p.frame(w)))
    together = p.framed("covariance of all", F.covar_pop(x, y).over(p.frame(w)))
    enough = (n >= max(2, w // 2)) & (F.col("t") >= w) & (n * spread > 1e-10)
    p.told("correlation")
    return F.when(enough, together / spread)


def _lag(x: Column, w: int, p: Pass) -> Column:
    return p.hold("lag", F.lag(x, w).over(p.own()))


def _plain(f: Callable[[Column, int, Pass], Column]) -> Op:
    return Op("rolling", (lambda a, w, p: f(a[0], w, p),), True)


OPS: dict[str, Op] = {
    "Abs": _row("unary", F.abs),
    "SLog1p": _row("unary", lambda x: F.signum(x) * F.log1p(F.abs(x))),
    "Inv": _row("unary", lambda x: safe_div(F.lit(1.0), x)),
    "Sign": _row("unary", F.signum),
    "Log": _row("unary", lambda x: F.when(x > 0, F.ln(x))),
    "Rank": Op("unary", (lambda a, w, p: rank_of(a[0]),), True),
    "Add": _row("binary", lambda x, y: x + y),
    "Sub": _row("binary", lambda x, y: x - y),
    "Mul": _row("binary", lambda x, y: x * y),
    "Div": _row("binary", safe_div),
    "Pow": _row("binary", F.pow),
    "Greater": Op("binary", (_both(F.greatest),)),
    "Less": Op("binary", (_both(F.least),)),
    "Ref": _plain(_lag),
    "TsMean": _over("mean"),
    "TsSum": _over("sum"),
    "TsStd": _over("std"),
    "TsVar": _over("var"),
    "TsMax": _over("max"),
    "TsMin": _over("min"),
    "TsMed": _full(lambda x, w, p: _stat("median", x, w, p), "median"),
    "TsDelta": _plain(lambda x, w, p: x - _lag(x, w, p)),
    "TsPctChange": _plain(lambda x, w, p: safe_div(x - _lag(x, w, p), _lag(x, w, p))),
    "TsDiv": _full(lambda x, w, p: safe_div(x, _stat("mean", x, w, p))),
    "TsIr": _full(lambda x, w, p: safe_div(_stat("mean", x, w, p), _stat("std", x, w, p))),
    "TsMinMaxDiff": _full(lambda x, w, p: _stat("max", x, w, p) - _stat("min", x, w, p)),
    "TsMaxDiff": _full(lambda x, w, p: x - _stat("max", x, w, p)),
    "TsMinDiff": _full(lambda x, w, p: x - _stat("min", x, w, p)),
    "TsMad": _full(_ts_mad, "deviation"),
    "TsSkew": _full(_ts_skew),
    "TsKurt": _full(_ts_kurt),
    "TsRank": _full(_ts_rank, "rank"),
    "TsWMA": _full(_ts_wma),
    "TsEMA": Op("rolling", (_ema_decay, _ema_level, _ema_local, _ema_end, _ema), True, endless=True),
    "TsCov": Op("pair", (_ts_cov,), True),
    "TsCorr": Op("pair", (_ts_corr,), True),
}
#: Operators whose two arguments may change places in a canonical key.
COMMUTE = frozenset({"Add", "Mul", "TsCorr", "TsCov"})
