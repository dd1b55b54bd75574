"""Rounding, means, quantiles and shares."""

import math
import random
import statistics
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.functions import numeric as nm
from scoreloom.functions.numeric import exact_ratio, pct
from scoreloom.operators.value_counts import value_counts


def scores(spark, values, groups=None):
    rows = [(g, None if v is None else Decimal(v)) for g, v in zip(groups or ["a"] * len(values), values)]
    return spark.createDataFrame(rows, "g string, x decimal(5,2)")


def one(df, *cols):
    return tuple(df.agg(*cols).first())


def test_quantile_is_rounded_as_a_decimal(spark):
    df = scores(spark, ["100.00", "100.33"])
    assert one(df, nm.pg_round(nm.percentile_cont(F.col("x"), 0.5), 2)) == (Decimal("100.17"),)


def test_iqr_comes_from_unrounded_quartiles(spark):
    df = scores(spark, ["100.00", "100.01", "100.02", "100.03"])
    assert one(df, nm.iqr(nm.percentile_cont(F.col("x"), [0.25, 0.5, 0.75]), 2)) == (Decimal("0.02"),)


def test_filtered_quantile(spark):
    df = scores(spark, ["1", "2", "3", "100"])
    assert one(df, nm.percentile_cont(F.col("x"), 0.5, where=F.col("x") < 50)) == (2.0,)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 20000), st.integers(1, 5)), min_size=1, max_size=30))
def test_weighted_forms_equal_the_plain_ones(spark, pairs):
    values = [Decimal(cents) / 100 for cents, times in pairs for _ in range(times)]
    counted = value_counts(scores(spark, values), [], F.col("x"))
    quantile, mean, sd = one(
        counted,
        nm.percentile_cont(F.col("value"), 0.25, F.col("n")),
        nm.weighted_mean(F.col("value"), F.col("n")),
        nm.sample_stddev(F.col("value"), F.col("n")),
    )
    ordered, position = sorted(values), (len(values) - 1) * 0.25
    low = int(position)
    high = min(low + 1, len(ordered) - 1)
    expected = float(ordered[low]) + (float(ordered[high]) - float(ordered[low])) * (position - low)
    assert quantile == pytest.approx(expected, abs=1e-9)
    assert float(mean) == pytest.approx(float(sum(values) / len(values)), abs=1e-9)
    if len(values) > 1:
        assert sd == pytest.approx(float(statistics.stdev(values)), abs=1e-6)
    else:
        assert sd is None


def test_deviation_of_one_row_is_null(spark):
    counted = value_counts(scores(spark, ["150"]), [], F.col("x"))
    assert one(counted, nm.cv(F.col("value"), F.col("n"), 2)) == (None,)


def test_null_values_carry_no_weight(spark):
    counted = value_counts(scores(spark, ["100", None, None, "200"]), [], F.col("x"))
    assert one(
        counted,
        nm.weighted_mean(F.col("value"), F.col("n")).cast("double"),
        nm.percentile_cont(F.col("value"), 0.5, F.col("n")),
        F.sum("n"),
    ) == (150.0, 150.0, 4)


def test_share_is_exact_and_null_without_a_whole(spark):
    df = spark.createDataFrame([(201, 20000), (1, 0)], "a long, b long")
    got = [r[0] for r in df.select(nm.pct(F.col("a"), F.col("b"), 2)).collect()]
    assert got == [Decimal("1.01"), None]


def test_score_mean_keeps_more_than_its_rounding_needs(spark):
    df = scores(spark, ["100.00", "100.00", "100.01"])
    mean = one(df, nm.score_mean(F.col("x")))[0]
    assert abs(mean - Decimal("300.01") / 3) < Decimal("1e-12")


def test_mean_of_scores_does_not_overflow_its_sum(spark):
    """A group total beyond thirteen digits, which a sum of decimal(5,2) could not hold."""
    df = spark.range(1).select(F.lit(Decimal("999.99")).cast("decimal(5,2)").alias("x"), F.lit(10**11).alias("n"))
    assert one(df, nm.weighted_mean(F.col("x"), F.col("n")))[0] == Decimal("999.99")


def test_ratios_are_rounded_as_fractions(spark):
    """Half up on the exact quotient, also a hair below or at a half, for counts of up to sixteen digits."""
    rng = random.Random(6)
    pairs = [(2512499999 * 4, 10**10), (1, 3), (0, 7), (10**16, 3), (1, 10**16), (5, 0)]
    for _ in range(400):
        whole = rng.randrange(1, 10 ** rng.randrange(1, 17))
        pairs.append((rng.randrange(0, whole + 1), whole))
    for places in (0, 2, 4, 6):
        for _ in range(40):
            whole = 2 * 10**places * rng.randrange(1, 10**8)
            half = rng.randrange(1, 10**places + 1) * whole // 10**places - whole // (2 * 10**places)
            pairs += [(half - 1, whole), (half, whole), (half + 1, whole)]
    df = spark.createDataFrame([(max(a, 0), b) for a, b in pairs], "a long, b long")
    places = (0, 2, 4, 6)
    got = df.select("a", "b", *[F.round(exact_ratio(F.col("a"), F.col("b")), p).alias(f"r{p}") for p in places], pct(F.col("a"), F.col("b"), 2).alias("p")).collect()
    for r in got:
        for p in places:
            expected = None if r["b"] == 0 else Fraction(math.floor(Fraction(r["a"], r["b"]) * 10**p + Fraction(1, 2)), 10**p)
            assert (None if r[f"r{p}"] is None else Fraction(r[f"r{p}"])) == expected
        if r["b"]:
            assert Fraction(r["p"]) == Fraction(math.floor(Fraction(100 * r["a"], r["b"]) * 100 + Fraction(1, 2)), 100)
