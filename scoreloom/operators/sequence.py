"""Measures along an ordered sequence of aggregated rows, such as a session calendar.

Apply these to aggregates, where the sequence is short; a window without
partition keys puts all its rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.numeric import exact_avg, half_up, pct


def number(window: WindowSpec) -> Column:
    return F.row_number().over(window).cast("long")


def delta(col: str, window: WindowSpec, places: int) -> Column:
    """Difference from the previous row; NULL on the first."""
    return half_up(F.col(col) - F.lag(col).over(window), places)


def smooth(col: str, window: WindowSpec, places: int, before: int = 1, after: int = 1) -> Column:
    """Centred moving mean; the frame shrinks at both ends."""
    return half_up(exact_avg(F.col(col)).over(window.rowsBetween(-before, after)), places)


def cumulative_share(col: str, window: WindowSpec, places: int) -> Column:
    """Running total in percent of the grand total; rows of equal order share one value."""
    return pct(F.sum(col).over(window), F.sum(col).over(W.partitionBy()), places)
