import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from scoreloom.functions.numeric import sample_stddev
from scoreloom.operators.quantiles import group_quantiles, large_quantiles, order_code
from scoreloom.operators.value_counts import value_counts
from scoreloom.sources.scratch import written

PS = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(4)
    return {
        "hot": [round(rng.uniform(-50, 50), 2) for _ in range(900)] + [7.25] * 300,
        "two": [1.1, 1.9],
        "one": [3.5],
        None: [float(k) for k in range(10)],
    }


def test_large_groups(spark, groups):
    df = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values] + [("two", None), ("none", None)], "k string, v double")
    got = {r["k"]: r["q"] for r in large_quantiles(df.repartition(5), ["k"], F.col("v"), PS).collect()}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        assert got[k] == pytest.approx(np.quantile(values, PS).tolist(), abs=1e-9)


def test_without_keys_and_without_rows(spark, groups):
    df = spark.createDataFrame([(v,) for v in groups["hot"]], "v double")
    assert large_quantiles(df, [], F.col("v"), PS).first()["q"] == pytest.approx(np.quantile(groups["hot"], PS).tolist(), abs=1e-9)
    assert large_quantiles(df.limit(0), [], F.col("v"), [0.5]).first()["q"] == [None]


def test_running_counts(spark, groups):
    df = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "k string, v double")
    got = {r["k"]: r["q"] for r in group_quantiles(value_counts(df, ["k"], F.col("v")), ["k"], PS).collect()}
    for k, values in groups.items():
        assert got[k] == pytest.approx(np.quantile(values, PS).tolist(), abs=1e-9)


def test_deviation_of_very_many_rows(spark):
    counts = spark.createDataFrame([("1.00", 10**13), ("50.00", 3 * 10**13), ("199.99", 1)], "v string, n long")
    counts = counts.select(F.col("v").cast("decimal(5,2)").alias("value"), "n")
    got = counts.agg(sample_stddev(F.col("value"), F.col("n")).alias("s")).first()["s"]
    assert got == pytest.approx((49**2 * 0.25 * 0.75) ** 0.5, rel=1e-9)


def test_deviation_with_more_places(spark):
    values = ["0.0010", "0.0025", "0.0040", "12.3456"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v").cast("decimal(9,4)").alias("value"), F.lit(1).alias("n"))
    got = df.agg(sample_stddev(F.col("value"), F.col("n"), 4).alias("s")).first()["s"]
    assert got == pytest.approx(statistics.stdev(map(float, values)), rel=1e-9)


def test_codes_keep_the_order_of_all_doubles(spark):
    rng = random.Random(8)
    values = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf")]
    values += [2.0**e for e in range(-1074, 1024)] + [np.nextafter(2.0**e, s) for e in range(-1022, 1024) for s in (0.0, math.inf)]
    values += [rng.uniform(0, 1) * 10.0 ** rng.randrange(-320, 300) for _ in range(3000)]
    values = sorted({float(s * v) for v in values for s in (1, -1)})
    df = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double").repartition(4)
    got = [tuple(r) for r in df.select("v", order_code(F.col("v"))).collect()]
    by_code = [v for v, _ in sorted(got, key=lambda r: r[1])]
    assert by_code[:-1] == values and math.isnan(by_code[-1])
    assert len({c for _, c in got}) == len(values) + 1


def test_a_million_values_inside_one_unit(spark):
    """All between 0 and 1: no task gets the group, and a third of them are one value."""
    made = spark.range(1_000_000).select(F.when(F.col("id") % 3 == 0, 0.625).otherwise(F.col("id") * 7919 % 1_000_003 / 1_000_003).alias("v"))
    values = np.array([0.625 if k % 3 == 0 else k * 7919 % 1_000_003 / 1_000_003 for k in range(1_000_000)])
    stored = written(made.repartition(8), "values")
    assert large_quantiles(stored, [], F.col("v"), PS).first()["q"] == pytest.approx(np.quantile(values, PS).tolist(), abs=1e-12)


def test_very_uneven_values(spark):
    values = [1e-300, 1e-300 * (1 + 2**-52), 3.0, 1e300, -1e300, 0.1, 0.1 + 1e-17, np.nextafter(0.1, 1)] * 3
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    got = large_quantiles(df, [], F.col("v"), [0.3, 0.5, 0.7]).first()["q"]
    assert got == pytest.approx(np.quantile(values, [0.3, 0.5, 0.7]).tolist(), rel=1e-12)


def test_conditions_share_the_passes(spark, groups):
    df = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "k string, v double").repartition(3)
    got = {r["k"]: (r["every"], r["low"]) for r in large_quantiles(df, ["k"], F.col("v"), [0.5], where={"every": F.lit(True), "low": F.col("v") < 3}).collect()}
    for k, values in groups.items():
        low = [v for v in values if v < 3]
        assert got[k][0] == pytest.approx([np.quantile(values, 0.5)], abs=1e-9)
        assert got[k][1] == (pytest.approx([np.quantile(low, 0.5)], abs=1e-9) if low else [None])
