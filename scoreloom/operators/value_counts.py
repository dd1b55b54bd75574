"""Counts per distinct value: the shared first level of all exact distribution measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(
    df: DataFrame, keys: list[str | Column], value: Column, tallies: dict[str, Column] | None = None
) -> DataFrame:
    """One row per (keys, value) with its row count n and any further tallies.

    Quantiles, means and deviations of a huge group need only this table. It is
    pre-aggregated before its shuffle and spread by value as well as by key, so a
    group that holds most of the rows does not end up in one task. Its size is
    bounded by the value grid (scores: two places on 0 to 200), not by the rows.
    """
    extra = [col.alias(name) for name, col in (tallies or {}).items()]
    return df.groupBy(*keys, value.alias("value")).agg(F.count("*").alias("n"), *extra)
