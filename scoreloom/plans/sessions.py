"""Module 1: the session calendar, day by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom import fixed_values as fv
from scoreloom.functions import rules
from scoreloom.functions.conditional import any_where, count_where, mean_where
from scoreloom.functions.numeric import MEAN, half_up, pct, percentile_cont, pg_round, weighted_mean
from scoreloom.functions.text import packed_id, unpacked_id
from scoreloom.operators import sequence
from scoreloom.operators.value_counts import value_counts
from scoreloom.plans.marts import attended
from scoreloom.schemas import MANDATORY


def person_days(exam_results: DataFrame, participants: DataFrame) -> DataFrame:
    """One row per person and day: mandatory mean, failure, status."""
    is_mandatory = F.col("subject_code").isin(*MANDATORY)
    days = (
        attended(exam_results)
        .groupBy(packed_id(F.col("out_id")).alias("_person"), "test_date")
        .agg(
            mean_where(F.col("scaled_score"), is_mandatory).cast(MEAN).alias("rating"),
            any_where(rules.failed(F.col("scaled_score")) & is_mandatory).alias("failed_mandatory"),
        )
    )
    people = participants.select(packed_id(F.col("out_id")).alias("_person"), "participant_status")
    return days.join(people, "_person").select(unpacked_id(F.col("_person")).alias("out_id"), "test_date", "rating", "failed_mandatory", "participant_status")


def daily_sessions(exam_results: DataFrame, participants: DataFrame) -> DataFrame:
    """The calendar, from the results themselves."""
    return calendar_of(person_days(exam_results, participants))


def calendar_of(days_of_people: DataFrame) -> DataFrame:
    """Per session date: attendance, cohort mix, scores, and their course over the calendar."""
    status = F.col("participant_status")
    counted = value_counts(
        days_of_people,
        ["test_date"],
        F.col("rating"),
        {
            "n_current": count_where(status == fv.STATUS_CURRENT_YEAR),
            "n_previous": count_where(status == fv.STATUS_PREVIOUS_YEARS),
            "n_penitentiary": count_where(status == fv.STATUS_PENITENTIARY),
            "n_failed": count_where(F.col("failed_mandatory")),
        },
    )
    rating, n, n_current, total = F.col("value"), F.col("n"), F.col("n_current"), F.sum("n")
    days = counted.groupBy("test_date").agg(
        total.alias("total_participants"),
        pct(F.sum("n_current"), total, 1).alias("current_year_graduates_pct"),
        pct(F.sum("n_previous"), total, 1).alias("previous_year_graduates_pct"),
        pct(F.sum("n_penitentiary"), total, 1).alias("penitentiary_graduates_pct"),
        half_up(weighted_mean(rating, n), 2).alias("avg_scaled_score_overall"),
        half_up(weighted_mean(rating, n_current), 2).alias("avg_score_current_year"),
        pg_round(percentile_cont(rating, 0.5, n), 2).alias("median_scaled_score_overall"),
        pg_round(percentile_cont(rating, 0.5, n_current), 2).alias("median_score_current_year"),
        pct(F.sum("n_failed"), total, 2).alias("fail_rate_mandatory"),
    )
    calendar = W.orderBy("test_date")
    return days.select(
        "test_date",
        sequence.number(calendar).alias("seq_session_number"),
        rules.session_phase(F.col("test_date")).alias("session_phase"),
        rules.weekday_label(F.col("test_date")).alias("day_of_week"),
        *days.columns[1:],
        sequence.delta("avg_score_current_year", calendar, 2).alias("day_over_day_delta_current_year"),
        sequence.smooth("avg_score_current_year", calendar, 2).alias("smoothed_avg_current_year"),
        sequence.cumulative_share("total_participants", calendar, 1).alias("cume_progress"),
    ).orderBy("test_date")
