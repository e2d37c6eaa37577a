"""Histories cut into stretches, so that the rows of one code are spread over tasks.

A row belongs to one stretch of ``size`` steps of t and is lent to the stretches after it that look back to it. Windows that
reach back ``back`` rows at most find in a row's stretch all that they would find in its code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH, LENT = "_stretch", "_lent"


def cut(panel: DataFrame, size: int, back: int) -> DataFrame:
    """panel with the number of a stretch, and rows lent to later ones. Rows lent beyond the last stretch of the calendar
    are dropped again with all lent ones."""
    own = F.floor((F.col("t") - 1) / size).cast("int")
    last = F.floor((F.col("t") - 1 + back) / size).cast("int")
    rows = panel.withColumn(STRETCH, F.explode(F.sequence(own, last)))
    return rows.withColumn(LENT, F.col(STRETCH) > own)


def join_up(panel: DataFrame) -> DataFrame:
    """The rows of a cut panel, each once."""
    return panel.filter(~F.col(LENT)).drop(STRETCH, LENT)
