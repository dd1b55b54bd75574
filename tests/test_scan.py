"""Long orders in range blocks: the same numbers, sums, frames and ranks as one window, without one."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from scoreloom.functions.numeric import pct
from scoreloom.operators import scan, sequence
from scoreloom.plans import etl, on_orders
from scoreloom.sources.scratch import written


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def instants(spark):
    """A million instants in no order."""
    made = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("ts"), (F.col("id") % 97).alias("n"))
    return written(made.repartition(6), "instants")


def test_a_million_instants(spark, instants):
    placed = scan.numbered(instants, [F.col("ts")], "place", {"running": "n"})
    plan = placed._jdf.queryExecution().toString()
    assert "Window" in plan and "windowspecdefinition(_row" not in plan, "no window over all rows"
    w = W.orderBy("ts")
    one = instants.select("ts", "n", F.row_number().over(w).cast("long").alias("place"), F.sum("n").over(w).alias("running"))
    assert placed.select(one.columns).exceptAll(one).isEmpty()
    assert placed.count() == 1_000_000


def test_blocks_are_even(instants):
    sizes = [r["count"] for r in scan.in_blocks(instants, [F.col("ts")]).groupBy("_block").count().collect()]
    assert sum(sizes) == 1_000_000 and len(sizes) >= 4 and max(sizes) < 400_000


@pytest.mark.parametrize(("before", "after", "size"), [(1, 1, 4), (0, 2, 5), (3, 3, 3), (1, 0, 1)])
def test_frames_across_chunks(spark, before, after, size):
    rng = random.Random(size)
    df = spark.createDataFrame([(k + 1, rng.randrange(100)) for k in range(57)], "place long, x long").repartition(5)
    near = scan.with_neighbours(df, "place", before, after, size)
    inner = W.partitionBy("_chunk").orderBy("place").rowsBetween(-before, after)
    got = near.withColumn("s", F.sum("x").over(inner)).filter("_own").select("place", "s")
    assert rows(got) == rows(df.select("place", F.sum("x").over(W.orderBy("place").rowsBetween(-before, after)).alias("s")))


def test_frames_longer_than_a_chunk_are_refused(spark):
    with pytest.raises(ValueError):
        scan.with_neighbours(spark.range(3), "id", 5, 0, 4)


def test_empty(spark):
    none = spark.createDataFrame([], "ts long, n long")
    assert scan.numbered(none, [F.col("ts")], "place", {"running": "n"}).collect() == []
    assert scan.ranked_values(none.withColumnRenamed("n", "k"), ["k"], "ts", "rank").collect() == []


def test_running_sum_over_nulls(spark):
    df = spark.createDataFrame([(k, None if k % 3 else Decimal(k)) for k in range(40)], "ts long, n decimal(10,2)").repartition(4)
    got = scan.numbered(df, [F.col("ts")], "place", {"running": "n"}).select("ts", "place", "running")
    assert rows(got) == rows(spark.createDataFrame([(k, k + 1, Decimal(sum(x for x in range(0, k + 1, 3)))) for k in range(40)], "ts long, place long, running decimal(20,2)"))


def test_event_instants_as_one_window(spark):
    rng = random.Random(3)
    data = [(rng.randrange(500), round(rng.uniform(0, 9), 2)) for _ in range(3000)]
    events = spark.createDataFrame(data, "s long, value double").select(F.timestamp_micros(F.col("s") * 1_000_003).alias("ts"), "value").repartition(5)
    got = on_orders.event_instants(events)
    days = events.groupBy("ts").agg(F.count("*").alias("event_count"), F.round(F.sum(F.col("value").cast("decimal(8,2)")) / F.count("value"), 2).alias("mean_value"))
    w = W.orderBy("ts")
    one = days.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("instant"),
        sequence.number(w),
        "event_count",
        "mean_value",
        sequence.delta("mean_value", w, 2),
        sequence.smooth("mean_value", w, 2),
        sequence.cumulative_share("event_count", w, 4),
    )
    assert rows(got) == rows(one)


def test_rank_where_one_key_holds_most_rows(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 20 == 9, F.lit(None)).otherwise("cold").alias("k"),
        F.when(F.col("id") % 1000 == 7, F.lit(None)).otherwise(F.col("id") * 31 % 20_011).alias("v"),
    )
    got = scan.ranked_values(df.repartition(7), ["k"], "v", "rank").select("k", "v", "n", "rank", pct(F.col("n"), F.col("group_rows"), 4).alias("share"))
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    rank = F.dense_rank().over(W.partitionBy("k").orderBy(F.col("v").desc_nulls_first())).cast("long").alias("rank")
    one = counts.select("k", "v", "n", rank, pct(F.col("n"), F.sum("n").over(W.partitionBy("k")), 4).alias("share"))
    assert rows(got) == rows(one)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one partition
    try:
        placed = scan.in_blocks(written(counts, "counts"), [F.col("k"), F.col("v")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in placed.where("k = 'hot'").groupBy("_block").count().collect()) < 12_000


def test_rank_without_keys(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (None,), (9,)], "v int")
    assert rows(scan.ranked_values(df, [], "v", "rank")) == rows(spark.createDataFrame([(3, 2, 5, 3), (1, 1, 5, 4), (None, 1, 5, 1), (9, 1, 5, 2)], "v int, n long, g long, r long"))


def test_equal_results_are_spread_and_numbered_alike(spark):
    """A million equal rows and some others: the same ids for each partitioning, no block with more than its share."""
    base = spark.range(1_030_000).select(F.unhex(F.md5(F.when(F.col("id") < 1_000_000, F.lit("same")).otherwise(F.col("id").cast("string")))).alias("_hash"))
    digests = set()
    for parts in (2, 5, 9):
        stored = written(base.repartition(parts), "base")
        placed = scan.numbered(stored, [F.col("_hash")], "id")
        digests.add(tuple(placed.agg(F.sum(F.hash("_hash", "id")), F.max("id"), F.count_distinct("id")).first()))
        sizes = [r["count"] for r in scan.in_blocks(stored, [F.col("_hash")], split_ties=True).groupBy("_block").count().collect()]
        assert max(sizes) < 400_000
    assert len(digests) == 1
    assert next(iter(digests))[1:] == (1_030_000, 1_030_000)


def test_result_ids_do_not_depend_on_partitions(spark, staging_of):
    record = {"outid": "A" * 8, "test_date": "17.05.2025", "ukr_status": "Отримав результат", "ukr_ball100": "150,5", "ukr_block": "Ukr"}
    staging = staging_of(*[record] * 300, *[{**record, "outid": f"B{k}"} for k in range(200)])
    made = [rows(etl.exam_results(staging.repartition(p))) for p in (1, 4, 9)]
    assert made[0] == made[1] == made[2]
    ids = sorted(r[0] for r in made[0])
    assert ids == list(range(1, 501))
    equal = sorted(r[0] for r in made[0] if r[1] == "a" * 8)
    assert equal == list(range(equal[0], equal[0] + 300))
