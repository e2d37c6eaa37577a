"""Statistics of many short frames at once: the rows of a code before each row, in Arrow batches.

Spark goes through every frame anew for every statistic, row by row. Where a depth asks for many, the panel is read in the order of
code and t instead, and each step adds the values some rows back to the statistics of a whole batch of rows. Values are added in
the order and by the formulas of Spark's aggregates, so both ways give the same doubles. A task holds a batch and the rows before
it that its frames reach into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

#: Statistics of one column, and of the rows in which two have values.
SINGLE = frozenset({"count", "mean", "sum", "std", "var", "max", "min", "sum of t x"})
PAIRED = frozenset({"pairs", "covariance", "std x", "std y", "covariance of all"})
#: Values that operators make of them, told as one column, clean: a statistic of frames in which all rows have a value, and a correlation.
FULL = {f"full {stat}": stat for stat in SINGLE}
TOLD = frozenset({*FULL, "correlation"})
#: A depth with more statistics than this is computed here.
FEW = 16


def _lags(x: np.ndarray, known: np.ndarray, place: np.ndarray, w: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, whether there is one) of the row j back in the same code, from the oldest of w to the row itself."""
    for j in range(min(w, len(known)) - 1, -1, -1):
        value, ok = np.zeros(x.shape), np.zeros(known.shape, bool)
        value[..., j:] = x[..., : x.shape[-1] - j]
        ok[j:] = known[: len(known) - j] & (place[j:] >= j)
        yield value, ok


def single(x: np.ndarray, t: np.ndarray, place: np.ndarray, w: int, kinds: set[str]) -> dict[str, np.ndarray]:
    """Statistics of the w rows up to each; NaN stands for a missing value."""
    wanted, kinds = kinds, {FULL.get(k, k) for k in kinds}
    known = ~np.isnan(x)
    both = np.vstack([x, t * x]) if "sum of t x" in kinds else x[None]
    n, total = np.zeros(len(x)), np.zeros(both.shape)
    mean, m2, most, least = np.zeros(len(x)), np.zeros(len(x)), np.full(len(x), -np.inf), np.full(len(x), np.inf)
    for v, ok in _lags(both, known, place, w):
        n = n + ok
        if kinds & {"mean", "sum", "sum of t x"}:
            total = np.where(ok, total + v, total)
        if kinds & {"std", "var"}:
            delta = v[0] - mean
            step = delta / n
            mean, m2 = np.where(ok, mean + step, mean), np.where(ok, m2 + delta * (delta - step), m2)
        if "max" in kinds:
            most = np.where(ok, np.maximum(most, v[0]), most)
        if "min" in kinds:
            least = np.where(ok, np.minimum(least, v[0]), least)
    some = lambda a: np.where(n > 0, a, np.nan)
    found = {
        "count": lambda: n, "mean": lambda: total[0] / n, "sum": lambda: some(total[0]), "std": lambda: np.sqrt(m2 / n), "var": lambda: m2 / n,
        "max": lambda: some(most), "min": lambda: some(least), "sum of t x": lambda: some(total[1]),
    }
    told = {k: found[k]() for k in kinds}
    return {k: np.where(n == w, told[FULL[k]], np.nan) if k in FULL else told[k] for k in wanted}


def _correlation(n: np.ndarray, xx: np.ndarray, yy: np.ndarray, xy: np.ndarray, t: np.ndarray, w: int) -> np.ndarray:
    """As TsCorr in operators/registry.py."""
    spread = np.sqrt(xx / n) * np.sqrt(yy / n)
    return np.where((n >= max(2, w // 2)) & (t >= w) & (n * spread > 1e-10), (xy / n) / spread, np.nan)


def paired(x: np.ndarray, y: np.ndarray, t: np.ndarray, place: np.ndarray, w: int, kinds: set[str]) -> dict[str, np.ndarray]:
    """Statistics of the rows among the w up to each in which both have a value."""
    known = ~np.isnan(x) & ~np.isnan(y)
    n, mx, my, xx, yy, xy = (np.zeros(len(x)) for _ in range(6))
    for (a, b), ok in _lags(np.vstack([x, y]), known, place, w):
        n = n + ok
        dx, dy = a - mx, b - my
        sx, sy = dx / n, dy / n
        mean_y = my + sy
        xy = np.where(ok, xy + dx * (b - mean_y), xy)
        xx, yy = np.where(ok, xx + dx * (dx - sx), xx), np.where(ok, yy + dy * (dy - sy), yy)
        mx, my = np.where(ok, mx + sx, mx), np.where(ok, mean_y, my)
    found = {
        "pairs": lambda: n, "std x": lambda: np.sqrt(xx / n), "std y": lambda: np.sqrt(yy / n),
        "covariance of all": lambda: xy / n, "covariance": lambda: np.where(n > 1, xy / (n - 1), np.nan),
        "correlation": lambda: _correlation(n, xx, yy, xy, t, w),
    }
    return {k: found[k]() for k in kinds}


def with_frames(panel: DataFrame, wanted: dict[str, tuple[str, tuple[str, ...], int]]) -> DataFrame:
    """panel (t, code, ...) with a column for each of wanted: name -> (statistic, its one or two columns, rows of the frame).
    Counts are doubles here."""
    together: dict[tuple[tuple[str, ...], int], dict[str, str]] = {}
    for name, (stat, inputs, w) in wanted.items():
        together.setdefault((inputs, w), {})[name] = stat
    sources = list(dict.fromkeys(c for inputs, _ in together for c in inputs))
    reach = max(w for _, w in together) - 1
    names = [n for group in together.values() for n in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch.select(["code", "t", *sources])])
            rows = (pa.concat_tables([before, rows]) if before is not None else rows).combine_chunks()
            lent = len(rows) - batch.num_rows
            code, at = rows["code"], np.arange(len(rows))
            first = np.concatenate(([True], pc.not_equal(code[1:], code[:-1]).to_numpy(zero_copy_only=False).astype(bool)))
            place = at - np.maximum.accumulate(np.where(first, at, 0))
            values = {c: rows[c].to_numpy().astype(float) for c in {"t", *sources}}
            found = {}
            with np.errstate(all="ignore"):
                for (inputs, w), group in together.items():
                    kinds = set(group.values())
                    if len(inputs) == 1:
                        told = single(values[inputs[0]], values["t"], place, w, kinds)
                    else:
                        told = paired(values[inputs[0]], values[inputs[1]], values["t"], place, w, kinds)
                    found |= {name: told[stat][lent:] for name, stat in group.items()}
            added = [pa.array(np.where(np.isfinite(found[n]), found[n], np.nan) if wanted[n][0] in TOLD else found[n], pa.float64(), from_pandas=True) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])
            before = rows.slice(max(len(rows) - reach, 0))

    schema = StructType([*panel.schema.fields, *(StructField(n, DoubleType()) for n in names)])
    # No exchange or sort where the rows of a code lie together in order already.
    return panel.repartition("code").sortWithinPartitions("code", "t").mapInArrow(run, schema)
