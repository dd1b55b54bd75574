"""Module 4: who chooses which elective."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import rules
from scoreloom.functions.conditional import count_where, sum_where
from scoreloom.functions.numeric import half_up, pct, percentile_cont, pg_round, settled, weighted_mean
from scoreloom.operators import benchmarks, share
from scoreloom.operators.value_counts import value_counts


def quartile_bounds(profiles: DataFrame) -> DataFrame:
    """One row: lower and upper quartile of the mandatory mean over all students."""
    counted = value_counts(profiles, [], F.col("mandatory_avg_score"))
    quartiles = percentile_cont(F.col("value"), [0.25, 0.75], F.col("n"))
    return counted.agg(quartiles.alias("q")).select(settled(F.col("q")[0]).alias("q1"), settled(F.col("q")[1]).alias("q3"))


def elective_strategy(profiles: DataFrame) -> DataFrame:
    """Per elective: size, both score distributions, quartile cohorts, failures and high scores.

    Both scores are counted by value in the same pass, as rows of one long table.
    """
    scores = F.array(
        F.struct(F.lit("mandatory").alias("kind"), F.col("mandatory_avg_score").alias("score")),
        F.struct(F.lit("elective").alias("kind"), F.col("elective_score").alias("score")),
    )
    long = profiles.filter(F.col("elective_subject").isNotNull()).select(
        "elective_subject", "failed_mandatory", F.explode(scores).alias("s")
    )
    counted = value_counts(
        long,
        ["elective_subject", F.col("s.kind").alias("kind")],
        F.col("s.score"),
        {"n_failed": count_where(F.col("failed_mandatory"))},
    )
    compared = benchmarks.attach(counted, quartile_bounds(profiles))

    value, n = F.col("value"), F.col("n")
    mandatory, elective = F.col("kind") == "mandatory", F.col("kind") == "elective"
    n_mandatory, n_elective = F.when(mandatory, n), F.when(elective, n)
    grouped = compared.groupBy("elective_subject").agg(
        sum_where(n, mandatory).alias("total_candidates"),
        half_up(weighted_mean(value, n_elective), 2).alias("elective_avg"),
        half_up(weighted_mean(value, n_mandatory), 2).alias("mandatory_avg"),
        pg_round(percentile_cont(value, 0.5, n_elective), 2).alias("elective_median"),
        pg_round(percentile_cont(value, 0.5, n_mandatory), 2).alias("mandatory_median"),
        sum_where(n, mandatory & (value < F.col("q1"))).alias("bottom"),
        sum_where(n, mandatory & value.between(F.col("q1"), F.col("q3"))).alias("middle"),
        sum_where(n, mandatory & (value > F.col("q3"))).alias("top"),
        sum_where(F.col("n_failed"), mandatory).alias("failed"),
        sum_where(n, mandatory & rules.high(value)).alias("high"),
        sum_where(n, elective & rules.failed(value)).alias("elective_failed"),
        sum_where(n, elective & rules.high(value)).alias("elective_high"),
    )
    c, total = F.col, F.col("total_candidates")
    return grouped.select(
        "elective_subject",
        "total_candidates",
        share.of_total(total, 2).alias("election_share"),
        "elective_avg",
        "mandatory_avg",
        "elective_median",
        "mandatory_median",
        (c("elective_median") - c("mandatory_median")).alias("median_delta"),
        share.of_total(c("bottom"), 2).alias("share_of_all_q1_students"),
        share.of_total(c("middle"), 2).alias("share_of_all_q2_students"),
        share.of_total(c("top"), 2).alias("share_of_all_q3_students"),
        pct(c("failed"), total, 1).alias("mandatory_failed_prc"),
        pct(c("high"), total, 1).alias("mandatory_high_achievers_prc"),
        pct(c("elective_failed"), total, 1).alias("elective_subject_failed_prc"),
        pct(c("elective_high"), total, 1).alias("elective_subject_high_achievers_prc"),
    ).orderBy(c("mandatory_median").desc_nulls_first(), "elective_subject")
