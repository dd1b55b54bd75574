"""Operators on small literal frames."""

import datetime
from decimal import Decimal

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.operators import benchmarks, sequence, share
from scoreloom.operators.dedup import first_per_key, surrogate_key
from scoreloom.operators.unpivot import unpivot_blocks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_per_key_with_one_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    kept = first_per_key(df, ["k"], [F.col("v").desc()])
    assert kept.count() == 2001
    assert kept.filter("k = -1").first().v == 2997
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2, "rows must be limited per key before the shuffle"


def test_surrogate_key_is_dense_and_independent_of_partitioning(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    first = rows(surrogate_key(df.repartition(7), "k", "n"))
    second = rows(surrogate_key(df.repartition(3, "k"), "k", "n", digits=2))
    assert first == second
    assert sorted(n for _, n in first) == list(range(1, 5001))


def test_unpivot_keeps_blocks_with_any_required_field(spark):
    df = spark.createDataFrame(
        [(1, "s", None, "x"), (2, None, "9", None), (3, None, None, "y"), (4, "s", "9", None)],
        "id int, status string, score string, lang string",
    )
    blocks = [
        {"code": F.lit("A"), "status": F.col("status"), "score": F.col("score")},
        {"code": F.lit("B"), "status": F.lit(None).cast("string"), "score": F.lit(None).cast("string")},
    ]
    got = unpivot_blocks(df, [F.col("id")], blocks, ["status", "score"])
    assert got.columns == ["id", "code", "status", "score"]
    assert sorted(tuple(r) for r in got.select("id", "code").collect()) == [(1, "A"), (2, "A"), (4, "A")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_sequence_measures(spark):
    values = [Decimal("126.41"), Decimal("130.24"), Decimal("129.73")]
    df = spark.createDataFrame(
        [(datetime.date(2025, 5, d), v, n) for d, v, n in zip((17, 24, 31), values, (1, 1, 2))],
        "day date, x decimal(10,2), n long",
    )
    w = W.orderBy("day")
    got = df.select(
        sequence.number(w), sequence.delta("x", w, 2), sequence.smooth("x", w, 2), sequence.cumulative_share("n", w, 1)
    )
    assert rows(got) == [
        (1, None, Decimal("128.33"), Decimal("25.0")),
        (2, Decimal("3.83"), Decimal("128.79"), Decimal("50.0")),
        (3, Decimal("-0.51"), Decimal("129.99"), Decimal("100.0")),
    ]


def test_running_total_gives_peers_one_value(spark):
    df = spark.createDataFrame([(1, 10), (2, 10), (2, 20), (3, 60)], "d int, n long")
    got = df.select("d", "n", sequence.cumulative_share("n", W.orderBy("d"), 1))
    assert [float(r[2]) for r in sorted(got.collect())] == [10.0, 40.0, 40.0, 100.0]


def test_shares_and_dense_rank(spark):
    df = spark.createDataFrame([("a", "p", 5), ("a", "q", 3), ("a", "r", 3), ("a", "s", 1), ("b", "p", 0)], "g string, e string, n long")
    n = F.col("n")
    got = {
        (r[0], r[1]): tuple(r[2:])
        for r in df.select("g", "e", share.of_total(n, 2), share.within(n, ["g"], 2), share.rank_within(n, ["g"])).collect()
    }
    assert [got["a", e][2] for e in "pqrs"] == [1, 2, 2, 3]
    assert got["a", "p"][:2] == (Decimal("41.67"), Decimal("41.67"))
    assert got["b", "p"] == (Decimal("0.00"), None, 1)


def test_share_of_a_given_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "g string, n long")
    total = df.agg(F.sum("n")).scalar()
    assert [float(r[0]) for r in df.orderBy("g").select(share.of_total(F.col("n"), 1, total)).collect()] == [25.0, 75.0]


def test_benchmark_is_attached_without_a_join(spark):
    df = spark.createDataFrame([(1,), (2,), (6,)], "x int")
    got = benchmarks.attach(df, df.agg(F.avg("x").alias("mean"), F.max("x").alias("top")))
    assert rows(got) == [(1, 3.0, 6), (2, 3.0, 6), (6, 3.0, 6)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
