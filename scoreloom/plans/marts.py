"""The two marts: attended exam results, and one academic profile per student."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import rules
from scoreloom.functions.conditional import any_where, max_code_where, max_where, mean_where
from scoreloom.functions.numeric import MEAN, half_up, score_mean
from scoreloom.functions.text import packed_id, unpacked_id
from scoreloom.operators.skew import spread_join
from scoreloom.schemas import ELECTIVE, MANDATORY

CLEAN_COLUMNS = [
    "result_id", "out_id", "test_date", "subject_code", "raw_score", "scaled_score",
    "participant_status", "macro_location", "gender", "institution_id", "institution_name",
    "institution_type", "reg_name", "area_name", "ter_name", "full_institution_location",
    "is_regional_center",
]
PROFILE_COLUMNS = [
    "out_id", "participant_status", "macro_location", "gender", "institution_id",
    "institution_name", "institution_type", "reg_name", "area_name", "ter_name",
    "full_institution_location", "score_ukr", "score_math", "score_hist", "mandatory_avg_score",
    "elective_subject", "elective_score", "overall_avg_score", "test_date",
    "total_subjects_completed", "failed", "failed_mandatory",
]


def attended(exam_results: DataFrame) -> DataFrame:
    """Exams that were sat, dated and scored; an unknown presence does not count."""
    return exam_results.filter(
        F.col("is_present") & F.col("test_date").isNotNull() & F.col("scaled_score").isNotNull()
    )


def located_people(participants: DataFrame, institutions: DataFrame) -> DataFrame:
    """Participants with their residence class and the place of their institution.

    Done per person, before any exam rows are involved, so the institution join
    carries each person once.
    """
    people = participants.select(
        "out_id",
        "participant_status",
        rules.macro_location(F.col("ter_type")).alias("macro_location"),
        "gender",
        F.col("institution_id").alias("_institution"),
    )
    schools = institutions.select(
        "institution_id", "institution_name", "institution_type", "reg_name", "area_name", "ter_name"
    )
    region, district, town = F.col("reg_name"), F.col("area_name"), F.col("ter_name")
    return (
        spread_join(people, schools, "_institution", "institution_id", "left")
        .drop("_institution")
        .withColumn("full_institution_location", rules.full_location(region, district, town))
        .withColumn(
            "is_regional_center",
            rules.is_regional_center(F.col("institution_id"), region, district, town),
        )
    )


def clean_exam_results(exam_results: DataFrame, participants: DataFrame, institutions: DataFrame) -> DataFrame:
    """One row per attended exam with its person and institution."""
    people = located_people(participants, institutions).withColumnRenamed("out_id", "_person")
    return spread_join(attended(exam_results), people, "out_id", "_person").select(*CLEAN_COLUMNS)


def student_profiles(exam_results: DataFrame, participants: DataFrame, institutions: DataFrame) -> DataFrame:
    """One row per student with an attended exam.

    The exams are folded to one narrow row per person first; person and place
    columns join on afterwards and are never grouped by. Two columns beyond the
    published profile, the unrounded overall mean and the regional-centre flag,
    let the regional statement read this mart instead of the exams.
    """
    score, code = F.col("scaled_score"), F.col("subject_code")
    is_mandatory = code.isin(*MANDATORY)
    folded = (
        attended(exam_results)
        .groupBy(packed_id(F.col("out_id")).alias("_person"))
        .agg(
            max_where(score, code == "Ukr").alias("score_ukr"),
            max_where(score, code == "Math").alias("score_math"),
            max_where(score, code == "Hist").alias("score_hist"),
            mean_where(score, is_mandatory).alias("_mandatory_mean"),
            max_code_where(code, ELECTIVE, ~is_mandatory).alias("elective_subject"),
            max_where(score, ~is_mandatory).alias("elective_score"),
            score_mean(score).alias("_overall_mean"),
            F.max("test_date").alias("test_date"),
            F.count("subject_code").alias("total_subjects_completed"),
            any_where(rules.failed(score)).alias("failed"),
            any_where(rules.failed(score) & is_mandatory).alias("failed_mandatory"),
        )
        .withColumn("mandatory_avg_score", half_up(F.col("_mandatory_mean"), 2).cast("decimal(5,2)"))
        .withColumn("overall_avg_score", half_up(F.col("_overall_mean"), 2).cast("decimal(5,2)"))
        .withColumn("overall_mean", F.col("_overall_mean").cast(MEAN))
    )
    people = located_people(participants.withColumn("out_id", packed_id(F.col("out_id"))), institutions)
    profiles = folded.join(people, F.col("_person") == F.col("out_id")).withColumn("out_id", unpacked_id(F.col("out_id")))
    return profiles.select(*PROFILE_COLUMNS, "overall_mean", "is_regional_center")
