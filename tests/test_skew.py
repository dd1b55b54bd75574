"""Joins whose key is heavy, or absent."""

import pytest
from pyspark.sql import functions as F
from scoreloom.operators.skew import heavy_values, spread_join


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the rows on one key, a third without any, the rest on keys of their own."""
    i = F.col("id")
    left = spark.range(30_000).select(i.alias("row"), F.when(i % 3 == 0, "hot").when(i % 3 == 2, i.cast("string")).alias("k"))
    right = spark.range(40_000).select(i.cast("string").alias("key"), (i * 2).alias("v")).unionByName(spark.createDataFrame([("hot", -1), (None, -2)], "key string, v long"))
    return left.repartition(6), right


def test_the_sketch_finds_the_heavy_key(sides):
    assert heavy_values(sides[0], "k") == ["hot"]
    assert heavy_values(sides[0].where("k <> 'hot'"), "k") == []
    assert heavy_values(sides[0].limit(0), "k") == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_as_a_plain_join(sides, how):
    left, right = sides
    plain = left.join(right, F.col("k") == F.col("key"), how)
    got = spread_join(left, right, "k", "key", how)
    assert got.columns == plain.columns
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_no_task_gets_the_heavy_key_or_the_absent_ones(spark, sides):
    left, right = sides
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = spread_join(left, right, "k", "key", "inner")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_000 and max(sizes) < 4_500
    assert "isnotnull(k" in plan, "rows without a key don't reach the join"
    assert "SortMergeJoin" in plan and "_piece" in plan


def test_other_joins_are_refused(sides):
    with pytest.raises(ValueError):
        spread_join(*sides, "k", "key", "full")
