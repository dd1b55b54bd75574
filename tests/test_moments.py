"""Exact moments: as whole-number arithmetic has them, and the same for any partitioning."""

import math
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from scoreloom.functions import moments

PLACES = {"x": 2, "y": 6}


def exact(pairs):
    """Deviation of x, correlation and slope of y on x, from fractions."""
    n = len(pairs)
    mx, my = (Fraction(sum(p[i] for p in pairs)) / n for i in (0, 1))
    xx, yy = (sum((Fraction(p[i]) - m) ** 2 for p in pairs) for i, m in ((0, mx), (1, my)))
    xy = sum((Fraction(x) - mx) * (Fraction(y) - my) for x, y in pairs)
    root = lambda f: math.sqrt(f.numerator / f.denominator)
    return root(xx / (n - 1)), float(xy) / (math.sqrt(float(xx)) * math.sqrt(float(yy))), float(xy / xx)


def measured(df):
    x, y = F.col("x"), F.col("y")
    return df.agg(moments.sample_stddev(x, 2).alias("s"), moments.corr(x, 2, y, 6).alias("c"), moments.slope(y, 6, x, 2).alias("b"))


def frame(spark, pairs):
    rows = [(None if x is None else str(x), None if y is None else str(y)) for x, y in pairs]
    return spark.createDataFrame(rows, "x string, y string").select(F.col("x").cast("decimal(18,2)").alias("x"), F.col("y").cast("decimal(18,6)").alias("y"))


@pytest.mark.parametrize("shift", [0, 10**13, -(10**13)])
def test_as_fractions_and_for_any_partitions(spark, shift):
    """Far from zero, where sums of squares in doubles keep no digit of the spread."""
    rng = random.Random(5)
    pairs = [(Decimal(shift) + Decimal(rng.randrange(-500, 500)) / 100, Decimal(rng.randrange(-(10**9), 10**9)) / 10**6) for _ in range(600)]
    pairs = [(x, y + x - Decimal(shift)) for x, y in pairs]
    df = frame(spark, pairs)
    made = [tuple(measured(df.repartition(p)).first()) for p in (1, 3, 7)]
    assert made[0] == made[1] == made[2]
    assert made[0] == pytest.approx(exact(pairs), rel=1e-12)


def test_rows_without_both_do_not_count_for_two(spark):
    df = frame(spark, [(1, 2), (2, 4), (4, 7), (None, 9), (5, None)])
    got = measured(df).first()
    _, c, b = exact([(1, 2), (2, 4), (4, 7)])
    assert (got["c"], got["b"]) == pytest.approx((c, b), rel=1e-12)
    assert got["s"] == pytest.approx(exact([(1, 0), (2, 1), (4, 0), (5, 0)])[0], rel=1e-12)


def test_what_does_not_vary(spark):
    got = [tuple(measured(frame(spark, rows)).first()) for rows in ([], [(1, 1)], [(3, 1), (3, 2)], [(None, None)])]
    assert got == [(None, None, None), (None, None, None), (0.0, None, None), (None, None, None)]


def test_many_rows_by_their_counts(spark):
    df = spark.createDataFrame([("10.00", 10**15), ("10.01", 10**15)], "v string, n long").select(F.col("v").cast("decimal(18,2)").alias("v"), "n")
    assert df.agg(moments.sample_stddev(F.col("v"), 2, F.col("n"))).first()[0] == pytest.approx(0.005, rel=1e-12)


def test_a_place_too_many_is_an_error(spark):
    df = spark.createDataFrame([("0.125",)], "v string").select(F.col("v").cast("decimal(9,3)").alias("v"))
    with pytest.raises(PySparkException, match="more than 2 places"):
        df.agg(moments.sample_stddev(F.col("v"), 2)).collect()
