"""Median, rank and mean deviation of wide windows: ordered values that slide, in place of a list a row.

A code's rows are one Arrow table (a stretch of its history at most, with the rows before it that its windows reach into). Its
distinct values are ordered once; a tree of sums over their places holds the window. A row enters and another leaves in a
logarithm of the number of values, the middle value is found by descending the tree, what lies below a value by adding up
prefixes. Memory is linear in rows, whatever the width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

#: Windows wider than this slide; narrower ones are frames of Spark, whose lists are short.
WIDE = 64


class Window:
    """A multiset of values with their places among all distinct values: counts and sums by binary indexed trees."""

    def __init__(self, distinct: np.ndarray):
        self.values = distinct.tolist()
        self.size = len(self.values)
        self.counts, self.sums = [0] * (self.size + 1), [0.0] * (self.size + 1)
        self.top = 1 << (self.size.bit_length() - 1) if self.size else 0

    def add(self, place: int, n: int) -> None:
        """n of the value at a place come in (or go, if negative)."""
        counts, sums, value, i = self.counts, self.sums, n * self.values[place], place + 1
        while i <= self.size:
            counts[i] += n
            sums[i] += value
            i += i & -i

    def below(self, place: int) -> tuple[int, float]:
        """(how many, their sum) at places before this one."""
        n, total = 0, 0.0
        while place > 0:
            n += self.counts[place]
            total += self.sums[place]
            place -= place & -place
        return n, total

    def nth(self, k: int) -> float:
        """The value that k others precede in order."""
        at, step = 0, self.top
        while step:
            if at + step <= self.size and self.counts[at + step] <= k:
                at += step
                k -= self.counts[at]
            step >>= 1
        return self.values[at]


def _median(held: Window, w: int, x: float, place: int) -> float:
    return held.nth(w // 2) if w % 2 else (held.nth(w // 2 - 1) + held.nth(w // 2)) / 2


def _rank(held: Window, w: int, x: float, place: int) -> float:
    lower, upto = held.below(place)[0], held.below(place + 1)[0]
    return (lower + (upto - lower + 1) / 2) / w


def _deviation(held: Window, w: int, x: float, place: int) -> float:
    total = held.below(held.size)[1]
    mean = total / w
    n, lower = held.below(int(np.searchsorted(held.values, mean)))
    return max((mean * n - lower) + (total - lower) - mean * (w - n), 0.0) / w


_FUNCTIONS = {"median": _median, "rank": _rank, "deviation": _deviation}


def slide(x: np.ndarray, w: int, kinds: list[str]) -> list[np.ndarray]:
    """The statistics of the w values up to each, where none of them is missing (NaN)."""
    out = [np.full(len(x), np.nan) for _ in kinds]
    known = ~np.isnan(x)
    distinct = np.unique(x[known])
    places = np.searchsorted(distinct, x).tolist()
    held, functions, inside = Window(distinct), [_FUNCTIONS[k] for k in kinds], 0
    values, present = x.tolist(), known.tolist()
    for i, place in enumerate(places):
        if i >= w and present[i - w]:
            held.add(places[i - w], -1)
            inside -= 1
        if present[i]:
            held.add(place, 1)
            inside += 1
            if inside == w:
                for column, f in zip(out, functions):
                    column[i] = f(held, w, values[i], place)
    return out


def with_slides(panel: DataFrame, keys: list[str], wanted: dict[str, tuple[str, str, int]]) -> DataFrame:
    """panel with a column for each of wanted: name -> (statistic, column of the values, width)."""
    together: dict[tuple[str, int], list[str]] = {}
    for name, (_, source, w) in wanted.items():
        together.setdefault((source, w), []).append(name)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["t"]))
        for (source, w), names in together.items():
            x = table[source].combine_chunks().to_numpy(zero_copy_only=False).astype(float)
            for name, found in zip(names, slide(x, w, [wanted[n][0] for n in names])):
                table = table.append_column(name, pa.array(found, from_pandas=True))
        return table.select(schema_names)

    schema = StructType([*panel.schema.fields, *(StructField(n, DoubleType()) for group in together.values() for n in group)])
    schema_names = schema.fieldNames()
    return panel.groupBy(*keys).applyInArrow(run, schema)
