"""First row per key, and dense surrogate keys without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep one row per key, the first by order.

    Spark limits each group to one row before the shuffle, so a key that holds
    a large share of all rows sends at most one row per input partition.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_position", F.row_number().over(window))
    return ranked.filter(F.col("_position") == 1).drop("_position")


def surrogate_key(df: DataFrame, key: str, name: str, digits: int = 3) -> DataFrame:
    """Number the rows 1..n by the hash order of a unique text key.

    The id depends on the set of keys alone, never on partitioning. Rows are
    numbered inside 16**digits hash buckets in parallel; only the bucket sizes,
    a table of that many rows, are summed up in one place and broadcast.
    """
    hashed = df.withColumn("_hash", F.md5(F.col(key))).withColumn("_bucket", F.substring("_hash", 1, digits))
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        hashed.groupBy("_bucket")
        .agg(F.count("*").alias("_size"))
        .select("_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy("_hash", key))
    numbered = hashed.withColumn("_inside", inside).join(F.broadcast(starts), "_bucket")
    return numbered.withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop(
        "_hash", "_bucket", "_start", "_inside"
    )
