"""Module 3: urban and rural students, institution types, rural schools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom import fixed_values as fv
from scoreloom.functions import rules
from scoreloom.functions.conditional import any_where, count_where, sum_where
from scoreloom.functions.numeric import cv, exact_avg, half_up, iqr, pct, percentile_cont, pg_round
from scoreloom.operators import benchmarks, share
from scoreloom.operators.skew import dealt
from scoreloom.operators.value_counts import value_counts

QUARTILES = [0.25, 0.5, 0.75]


def _counted(students: DataFrame, key: str) -> DataFrame:
    """Students per key and mandatory mean, with the number who failed a mandatory subject.

    A missing score is not a failure, although it makes the condition NULL.
    """
    any_fail = rules.failed(F.col("score_ukr")) | rules.failed(F.col("score_math")) | rules.failed(F.col("score_hist"))
    return value_counts(students, [key], F.col("mandatory_avg_score"), {"n_failed": count_where(any_fail)})


def _summarised(counted: DataFrame, key: str, *more) -> DataFrame:
    value, n, total = F.col("value"), F.col("n"), F.sum("n")
    return counted.groupBy(key).agg(
        total.alias("total_students"),
        percentile_cont(value, QUARTILES, n).alias("_quartiles"),
        pct(sum_where(n, rules.high(value)), total, 2).alias("high_achievers_percentage"),
        pct(F.sum("n_failed"), total, 2).alias("failed_percentage"),
        *more,
    )


def _quartile(position: int):
    return F.col("_quartiles")[position]


def macro_locations(profiles: DataFrame) -> DataFrame:
    """Score distribution by place of residence."""
    known = profiles.filter(
        F.col("macro_location").isin(fv.LOCATION_CITY, fv.LOCATION_VILLAGE, fv.LOCATION_ABROAD)
    )
    return (
        _summarised(_counted(known, "macro_location"), "macro_location")
        .select(
            "macro_location",
            "total_students",
            pg_round(_quartile(0), 2).alias("mandatory_q1_score"),
            pg_round(_quartile(1), 2).alias("mandatory_median_score"),
            pg_round(_quartile(2), 2).alias("mandatory_q3_score"),
            iqr(F.col("_quartiles"), 2).alias("iqr"),
            "high_achievers_percentage",
            "failed_percentage",
        )
        .orderBy(F.col("mandatory_median_score").desc_nulls_first(), "macro_location")
    )


def _rural(profiles: DataFrame) -> DataFrame:
    return profiles.filter(F.col("macro_location") == fv.LOCATION_VILLAGE)


def institution_types(profiles: DataFrame, min_students: int = fv.MIN_STUDENTS_PER_TYPE) -> DataFrame:
    """Score distribution of rural students by type of institution, large types only."""
    rural = _rural(profiles).filter(F.col("institution_type").isNotNull())
    spread = cv(F.col("value"), F.col("n"), 2).alias("coefficient_of_variation")
    return (
        _summarised(_counted(rural, "institution_type"), "institution_type", spread)
        .filter(F.col("total_students") >= min_students)
        .select(
            "institution_type",
            "total_students",
            pg_round(_quartile(0), 2).alias("q1"),
            pg_round(_quartile(1), 2).alias("median"),
            pg_round(_quartile(2), 2).alias("q3"),
            iqr(F.col("_quartiles"), 2).alias("iqr"),
            "high_achievers_percentage",
            "failed_percentage",
            "coefficient_of_variation",
        )
        .orderBy(F.col("median").desc_nulls_first(), "institution_type")
    )


def national_medians(profiles: DataFrame) -> DataFrame:
    """One row: median mandatory mean of rural and of urban students."""
    known = profiles.filter(F.col("macro_location").isin(fv.LOCATION_VILLAGE, fv.LOCATION_CITY))
    counted = value_counts(known, ["macro_location"], F.col("mandatory_avg_score"))
    value, n, place = F.col("value"), F.col("n"), F.col("macro_location")
    return counted.agg(
        percentile_cont(value, 0.5, n, where=place == fv.LOCATION_VILLAGE).alias("rural_median"),
        percentile_cont(value, 0.5, n, where=place == fv.LOCATION_CITY).alias("urban_median"),
    )


def _ranked_schools(profiles: DataFrame, min_students: int) -> DataFrame:
    """Schools with enough rural students, ranked against the national medians."""
    rural = _rural(profiles).filter(F.col("institution_id").isNotNull())
    has_high = any_where(rules.high(F.col("value"))).alias("_has_high")
    schools = _summarised(_counted(rural, "institution_id"), "institution_id", has_high).filter(
        F.col("total_students") >= min_students
    )
    compared = benchmarks.attach(schools, national_medians(profiles))
    rank = rules.school_rank(F.col("_has_high"), _quartile(1), F.col("rural_median"), F.col("urban_median"))
    return compared.withColumn("school_rank", rank)


def rural_schools(
    profiles: DataFrame, institutions: DataFrame, min_students: int = fv.MIN_STUDENTS_PER_SCHOOL
) -> DataFrame:
    """The ranked list of schools. Names join on after the aggregation, by whose key the schools then lie."""
    ranked = _ranked_schools(profiles, min_students)
    names = institutions.select("institution_id", "institution_name", "reg_name", "institution_type")
    return (
        ranked.join(dealt(names), "institution_id")
        .select(
            "institution_id",
            "institution_name",
            "reg_name",
            "institution_type",
            "total_students",
            pg_round(_quartile(1), 2).alias("mandatory_median_score"),
            iqr(F.col("_quartiles"), 2).alias("iqr"),
            "high_achievers_percentage",
            "failed_percentage",
            "school_rank",
        )
        .orderBy(
            F.col("mandatory_median_score").desc_nulls_first(), F.col("total_students").desc(), "institution_id"
        )
    )


def school_clusters(profiles: DataFrame, min_students: int = fv.MIN_STUDENTS_PER_SCHOOL) -> DataFrame:
    """How many schools fall under each rank, and their mean median."""
    ranked = _ranked_schools(profiles, min_students)
    clusters = ranked.groupBy(F.col("school_rank").alias("school_cluster")).agg(
        F.count("*").alias("institutions_count"),
        F.sum("total_students").alias("total_graduates_covered"),
        half_up(exact_avg(_quartile(1)), 2).alias("cluster_avg_median_score"),
    )
    return clusters.select(
        "school_cluster",
        "institutions_count",
        "total_graduates_covered",
        share.of_total(F.col("institutions_count"), 2).alias("cluster_share_pct"),
        "cluster_avg_median_score",
    ).orderBy(F.col("institutions_count").desc(), "school_cluster")
