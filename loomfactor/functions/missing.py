"""Missing values: NULL is the only one. Every derived cell passes through clean()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Denominators closer to zero than this give no value.
EPS = 1e-9


def clean(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= EPS, a / b)
