"""Shares and ranks over an aggregate.

The total over all groups is a window without keys: use it where the number of
groups is fixed by the domain (subjects, archetypes, segments). For a large number
of groups pass the total itself, for example a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.numeric import pct


def of_total(n: Column, places: int, total: Column | None = None) -> Column:
    return pct(n, F.sum(n).over(W.partitionBy()) if total is None else total, places)


def within(n: Column, groups: list[str], places: int) -> Column:
    return pct(n, F.sum(n).over(W.partitionBy(*groups)), places)


def rank_within(n: Column, groups: list[str]) -> Column:
    """Dense rank, largest first."""
    return F.dense_rank().over(W.partitionBy(*groups).orderBy(n.desc_nulls_first())).cast("long")
