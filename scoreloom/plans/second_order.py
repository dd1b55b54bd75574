"""Statistics over the finished results: volatility, trends, correlations, ratios.

Inputs are the result tables of the modules (a few dozen rows each).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom import fixed_values as fv
from scoreloom.functions import moments
from scoreloom.functions.conditional import count_where, sum_where
from scoreloom.functions.numeric import exact_avg, half_up, pg_round, safe_div

MAIN_MONTH = 6
FIRST_MONTH = 5
CENTRALISED_FROM = Decimal("1.40")


def _main_session(days: DataFrame) -> DataFrame:
    return days.filter(F.month("test_date") == MAIN_MONTH)


def day_volatility(days: DataFrame) -> DataFrame:
    """One row per year over its main session: day-to-day jumps, score trend, load against score."""
    jump, score = F.col("day_over_day_delta_current_year"), F.col("avg_score_current_year")
    return _main_session(days).groupBy(F.year("test_date").cast("long").alias("session_year")).agg(
        F.count("*").alias("sessions"),
        pg_round(moments.sample_stddev(jump, 2), 4).alias("delta_stddev"),
        F.min("day_over_day_delta_current_year").alias("delta_min"),
        F.max("day_over_day_delta_current_year").alias("delta_max"),
        pg_round(moments.slope(score, 2, F.col("seq_session_number"), 0), 4).alias("score_trend"),
        pg_round(moments.corr(F.col("total_participants"), 0, score, 2), 4).alias("load_score_correlation"),
    )


def weekly_failures(days: DataFrame) -> DataFrame:
    """Main session by ISO week: plain mean of the daily failure rates."""
    return (
        _main_session(days)
        .groupBy(
            F.expr("extract(YEAROFWEEK FROM test_date)").cast("long").alias("iso_year"),
            F.weekofyear("test_date").cast("long").alias("iso_week"),
        )
        .agg(
            F.count("*").alias("sessions"),
            half_up(exact_avg(F.col("fail_rate_mandatory")), 4).alias("mean_fail_rate"),
        )
        .orderBy("iso_year", "iso_week")
    )


def day_clusters(days: DataFrame) -> DataFrame:
    """The two named groups of main-session days: plain means of their daily figures."""
    date = F.date_format("test_date", "yyyy-MM-dd")
    cluster = F.when(date.isin(*fv.LANGUAGE_DAYS), "language").when(date.isin(*fv.MASS_DAYS), "mass")
    return (
        days.withColumn("day_cluster", cluster)
        .filter(F.col("day_cluster").isNotNull())
        .groupBy("day_cluster")
        .agg(
            F.count("*").alias("sessions"),
            *[
                half_up(exact_avg(F.col(source)), 4).alias(name)
                for name, source in (
                    ("mean_participants", "total_participants"),
                    ("mean_score_current_year", "avg_score_current_year"),
                    ("mean_median_current_year", "median_score_current_year"),
                    ("mean_fail_rate", "fail_rate_mandatory"),
                )
            ],
        )
        .orderBy("day_cluster")
    )


def region_summary(regions: DataFrame) -> DataFrame:
    """One row over the regions that have a quotient."""
    quotient = F.col("monopoly_lq_index")
    return regions.filter(quotient.isNotNull()).agg(
        F.count("*").alias("regions"),
        half_up(exact_avg(quotient), 4).alias("mean_lq"),
        count_where(quotient > 1).alias("regions_above_one"),
        count_where(quotient >= F.lit(CENTRALISED_FROM)).alias("regions_centralised"),
        half_up(exact_avg(F.col("delta_median")), 4).alias("mean_delta_median"),
        half_up(exact_avg(F.col("fail_rate_ratio")), 4).alias("mean_fail_rate_ratio"),
        pg_round(moments.corr(F.col("delta_median"), 2, F.col("fail_rate_ratio"), 2), 4).alias("gap_ratio_correlation"),
    )


def headline_ratios(days: DataFrame, electives: DataFrame, archetypes: DataFrame, choices: DataFrame) -> DataFrame:
    """Headline figures, one per row; those of the calendar are of its last year."""
    days = days.withColumn("_last_year", F.max(F.year("test_date")).over(W.partitionBy())).filter(F.year("test_date") == F.col("_last_year"))

    def figure(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.cast("decimal(38,10)").alias("value")).select(F.lit(name).alias("statistic"), "value")

    size, kind = F.col("total_students").cast("decimal(18,0)"), F.col("archetype")
    taken = F.col("pct_within_archetype")
    return (
        figure(days, "first_month_participants", sum_where(F.col("total_participants"), F.month("test_date") == FIRST_MONTH))
        .unionByName(
            figure(
                archetypes,
                "humanities_per_stem",
                half_up(
                    safe_div(sum_where(size, kind == fv.ARCHETYPE_HUMANITIES), sum_where(size, kind == fv.ARCHETYPE_STEM)),
                    4,
                ),
            )
        )
        .unionByName(
            figure(
                electives,
                "weakest_quarter_in_refuge_electives",
                sum_where(F.col("share_of_all_q1_students"), F.col("elective_subject").isin(*fv.REFUGE_ELECTIVES)),
            )
        )
        .unionByName(
            figure(
                choices,
                "stem_students_outside_stem_electives",
                F.lit(Decimal("100"))
                - sum_where(taken, (kind == fv.ARCHETYPE_STEM) & F.col("elective_subject").isin(*fv.STEM_ELECTIVES)),
            )
        )
        .orderBy("statistic")
    )
