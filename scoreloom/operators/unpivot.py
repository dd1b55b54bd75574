"""Wide blocks to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_blocks(
    df: DataFrame, keep: list[Column], blocks: list[dict[str, Column]], required: list[str]
) -> DataFrame:
    """One output row per block that has at least one of the required fields.

    A block is a set of equally named expressions. The rows are made and filtered
    inside one generated stage, without a shuffle.
    """
    rows = F.array(*[F.struct(*[col.alias(name) for name, col in block.items()]) for block in blocks])
    unpivoted = df.select(*keep, F.explode(rows).alias("_block"))
    filled = reduce(Column.__or__, [F.col(f"_block.{name}").isNotNull() for name in required])
    kept = [c for c in unpivoted.columns if c != "_block"]
    return unpivoted.filter(filled).select(*kept, *[F.col(f"_block.{name}") for name in blocks[0]])
