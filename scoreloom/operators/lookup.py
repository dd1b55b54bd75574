"""Priority lookup: resolve each reference to at most one row of a dimension.

A priority match ("by id, else by code and name, else by name and place, best
place first, smallest id last") is written as an ordered list of tiers. Each tier
is a plain equality lookup; the first tier with a hit wins. The dimension is
reduced to one id per (tier, key) before the join, so no reference ever meets
more than one row per tier: work is linear in references and dimension rows, and
two large groups with the same key are never paired row by row. Neither side is
broadcast: a dimension row has an entry for each tier, far more than its file shows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.skew import dealt


class Tier(NamedTuple):
    """Equality of the paired expressions, on references and dimension rows that qualify."""

    pairs: list[tuple[Column, Column]]
    reference_if: Column
    dimension_if: Column


def _tier_keys(tiers: list[Tier], side: int) -> Column:
    """Array with one (tier, key) per tier that the row takes part in, NULL for the others."""
    entries = []
    for position, tier in enumerate(tiers):
        parts = [pair[side] for pair in tier.pairs]
        qualifies = tier.reference_if if side == 0 else tier.dimension_if
        complete = reduce(Column.__and__, [p.isNotNull() for p in parts], qualifies)
        entry = F.struct(F.lit(position).alias("tier"), F.array(*parts).alias("key"))
        entries.append(F.when(complete, entry))
    return F.array(*entries)


def _exploded(df: DataFrame, keep: list[Column], tiers: list[Tier], side: int) -> DataFrame:
    exploded = df.select(*keep, F.explode(_tier_keys(tiers, side)).alias("_entry"))
    kept = [c for c in exploded.columns if c != "_entry"]
    return exploded.filter(F.col("_entry").isNotNull()).select(*kept, "_entry.tier", "_entry.key")


def candidates(
    references: DataFrame, dimension: DataFrame, by: list[str], tiers: list[Tier], id_col: str
) -> DataFrame:
    """Map each reference tuple that resolves to its id, the tier that found it, and how many rows it could have meant there.

    The references must be distinct in the by columns; they may carry further
    columns derived from those for the tiers to use.
    """
    wanted = _exploded(references, [F.col(c) for c in by], tiers, 0)
    index = (
        _exploded(dimension, [F.col(id_col)], tiers, 1)
        .groupBy("tier", "key")
        .agg(F.min(id_col).alias("_found"), F.count("*").alias("_rows"))
    )
    return (
        wanted.join(dealt(index), ["tier", "key"])
        .groupBy(*by)
        .agg(F.min_by("_found", "tier").alias(id_col), F.min("tier").alias("tier"), F.min_by("_rows", "tier").alias("candidates"))
    )


def tiered_lookup(
    references: DataFrame, dimension: DataFrame, by: list[str], tiers: list[Tier], id_col: str
) -> DataFrame:
    """The same without the number of candidates."""
    return candidates(references, dimension, by, tiers, id_col).drop("candidates")


def attach_lookup(df: DataFrame, mapping: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Left join of a tuple mapping back onto rows; NULL parts of the tuple match NULL."""
    renamed = mapping.select(*[F.col(c).alias(f"_ref_{c}") for c in by], *values)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_ref_{c}")) for c in by])
    return df.join(dealt(renamed), same, "left").drop(*[f"_ref_{c}" for c in by])
