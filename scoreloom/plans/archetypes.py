"""Module 5: skill-profile archetypes and their elective choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom import fixed_values as fv
from scoreloom.functions import rules
from scoreloom.functions.conditional import count_where
from scoreloom.functions.numeric import half_up, pct, score_mean
from scoreloom.operators import share


def typed_students(profiles: DataFrame) -> DataFrame:
    """Students with all three mandatory scores, and their archetype."""
    math, language, history = F.col("score_math"), F.col("score_ukr"), F.col("score_hist")
    return (
        profiles.dropna(subset=["score_math", "score_ukr", "score_hist"])
        .withColumn("stem", math.cast("decimal(8,3)"))
        .withColumn("humanities", rules.humanities_score(language, history))
        .withColumn("archetype", rules.archetype(math, language, history))
    )


def archetype_profiles(profiles: DataFrame) -> DataFrame:
    """Size, mean scores, gender and residence of each archetype."""
    total = F.count("*")
    stem, humanities = F.col("stem"), F.col("humanities")
    groups = typed_students(profiles).groupBy("archetype").agg(
        total.alias("total_students"),
        half_up(score_mean(stem, "decimal(8,3)"), 1).alias("avg_stem_score"),
        half_up(score_mean(humanities, "decimal(8,3)"), 1).alias("avg_humanities_score"),
        half_up(score_mean(stem - humanities, "decimal(8,3)"), 1).alias("avg_asymmetry_delta"),
        *[
            pct(count_where(F.col(column) == value), total, 1).alias(name)
            for name, column, value in (
                ("women_pct", "gender", fv.WOMEN),
                ("men_pct", "gender", fv.MEN),
                ("rural_pct", "macro_location", fv.LOCATION_VILLAGE),
                ("city_pct", "macro_location", fv.LOCATION_CITY),
                ("abroad_pct", "macro_location", fv.LOCATION_ABROAD),
            )
        ],
    )
    return groups.select(
        "archetype",
        "total_students",
        share.of_total(F.col("total_students"), 1).alias("archetype_share"),
        *groups.columns[2:],
    ).orderBy(F.col("total_students").desc(), "archetype")


def elective_choices(profiles: DataFrame) -> DataFrame:
    """Electives within each archetype: count, share, rank and mean score."""
    chosen = typed_students(profiles).filter(F.col("elective_subject").isNotNull())
    counts = chosen.groupBy("archetype", "elective_subject").agg(
        F.count("*").alias("students_count"),
        half_up(score_mean(F.col("elective_score")), 1).alias("avg_elective_score"),
    )
    n = F.col("students_count")
    return counts.select(
        "archetype",
        "elective_subject",
        "students_count",
        share.within(n, ["archetype"], 2).alias("pct_within_archetype"),
        share.rank_within(n, ["archetype"]).alias("subject_rank_in_archetype"),
        "avg_elective_score",
    ).orderBy("archetype", n.desc(), "elective_subject")
