"""Staging to star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom import fixed_values as fv
from scoreloom.functions.text import (
    canonical_uuid,
    cascade_key,
    has_value,
    is_present,
    null_sentinel,
    packed_id,
    parse_date,
    parse_score,
    unpacked_id,
)
from scoreloom.operators.dedup import first_per_key, surrogate_key
from scoreloom.operators.lookup import Tier, attach_lookup, tiered_lookup
from scoreloom.operators.scan import numbered_by_digest
from scoreloom.operators.unpivot import unpivot_blocks
from scoreloom.schemas import SUBJECTS

REFERENCE = ["eo_edeboid", "eo_edrpou", "eo_name", "eo_reg_name", "eo_area_name", "eo_ter_name"]

# The reference columns that are compared by value, without the missing-value text.
REFERENCE_VALUES = {
    "_edebo": "eo_edeboid",
    "_edrpou": "eo_edrpou",
    "_town": "eo_ter_name",
    "_district": "eo_area_name",
}

INSTITUTION_COLUMNS = {
    "edebo_id": "eo_edeboid",
    "edrpou": "eo_edrpou",
    "institution_type": "eo_type_name",
    "reg_name": "eo_reg_name",
    "area_name": "eo_area_name",
    "ter_name": "eo_ter_name",
    "parent_governance": "eo_parent",
}
PARTICIPANT_COLUMNS = {
    "gender": "sex_type_name",
    "participant_status": "reg_type_name",
    "ter_type": "ter_type_name",
    "reg_name": "reg_name",
    "area_name": "area_name",
    "ter_name": "ter_name",
}


def institutions(staging: DataFrame) -> DataFrame:
    """One row per institution: the record that knows most about it survives.

    Records with a governing body come first, then those with a registry code;
    the remaining columns settle ties so that reruns agree. Equal records collapse
    first, by hash aggregation in the input tasks: only distinct ones are ranked.
    """
    typed = staging.filter(has_value("eo_name")).select(
        cascade_key(["eo_edeboid", "eo_edrpou"], ["eo_name", "eo_reg_name", "eo_area_name", "eo_ter_name"]).alias("_key"),
        F.col("eo_name").alias("institution_name"),
        *[null_sentinel(raw).alias(name) for name, raw in INSTITUTION_COLUMNS.items()],
    )
    order = [
        F.col("parent_governance").isNotNull().desc(),
        F.col("edrpou").isNotNull().desc(),
        F.col("institution_name").asc(),
        *[F.col(name).asc_nulls_first() for name in INSTITUTION_COLUMNS],
    ]
    unique = surrogate_key(first_per_key(typed.distinct(), ["_key"], order), "_key", "institution_id")
    return unique.select(
        "institution_id", "edebo_id", "edrpou", "institution_name", "institution_type",
        "reg_name", "area_name", "ter_name", "parent_governance",
    )


def resolution_tiers() -> list[Tier]:
    """How a record's institution reference is resolved, best tier first.

    With an id only the id counts. With a registry code, code and name must
    agree, and among several such institutions one with the same town, then the
    same district, is preferred; a differing value ranks above an unknown one.
    With neither, name and region must agree, and district and town too unless
    the record marks them as missing. Within a tier the smallest id wins.
    """
    edebo, edrpou, town, district = [F.col(name) for name in REFERENCE_VALUES]
    same_town, same_district = (town, F.col("ter_name")), (district, F.col("area_name"))
    same_name = (F.col("eo_name"), F.col("institution_name"))
    anything = F.lit(True)

    tiers = [Tier([(edebo, F.col("edebo_id"))], anything, anything)]

    # Per place column: equal, known on both sides (hence different), or not comparable.
    def preferences(pair):
        reference, candidate = pair
        return [
            ([pair], anything, anything),
            ([], reference.isNotNull(), candidate.isNotNull()),
            ([], anything, anything),
        ]

    by_code = [(edrpou, F.col("edrpou")), same_name]
    for town_pairs, town_ref, town_dim in preferences(same_town):
        for district_pairs, district_ref, district_dim in preferences(same_district):
            tiers.append(
                Tier(
                    [*by_code, *town_pairs, *district_pairs],
                    edebo.isNull() & town_ref & district_ref,
                    town_dim & district_dim,
                )
            )

    def is_wildcard(raw):
        return F.col(raw) == fv.MISSING

    by_place = [same_name, (F.col("eo_reg_name"), F.col("reg_name"))]
    no_code = edebo.isNull() & edrpou.isNull()
    tiers += [
        Tier([*by_place, same_town, same_district], no_code, anything),
        Tier([*by_place, same_town], no_code & is_wildcard("eo_area_name"), anything),
        Tier([*by_place, same_district], no_code & is_wildcard("eo_ter_name"), anything),
        Tier(by_place, no_code & is_wildcard("eo_area_name") & is_wildcard("eo_ter_name"), anything),
    ]
    return tiers


# Stands for NULL where all fields of a result make one text.
ABSENT_FIELD = "-"

TIERS_BY_ID = 1
TIERS_BY_CODE = 9


def resolve_institutions(staging: DataFrame, dimension: DataFrame) -> DataFrame:
    """Map the distinct institution references of staging to institution ids."""
    references = staging.filter(has_value("eo_name")).select(*REFERENCE).distinct()
    valued = references.withColumns({name: null_sentinel(raw) for name, raw in REFERENCE_VALUES.items()})
    return tiered_lookup(valued, dimension, REFERENCE, resolution_tiers(), "institution_id")


def participants(staging: DataFrame, dimension: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """One row per person with at most one institution; mapping: resolved references, if there are any already."""
    typed = staging.select(
        canonical_uuid("outid").alias("out_id"),
        null_sentinel("birth").cast("short").alias("birth_year"),
        *[null_sentinel(raw).alias(name) for name, raw in PARTICIPANT_COLUMNS.items()],
        *REFERENCE,
    ).filter(F.col("out_id").isNotNull())
    order = [F.col(name).asc_nulls_first() for name in ["birth_year", *PARTICIPANT_COLUMNS, *REFERENCE]]
    people = first_per_key(typed, ["out_id"], order)
    resolved = attach_lookup(people, mapping or resolve_institutions(staging, dimension), REFERENCE, ["institution_id"])
    return resolved.select(
        "out_id", "birth_year", "gender", "participant_status", "ter_type",
        "reg_name", "area_name", "ter_name", "institution_id",
    )


def _subject_blocks() -> list[dict]:
    return [
        {
            "subject_code": F.lit(s.code),
            "exam_lang": F.lit(s.language) if s.language else null_sentinel(f"{s.prefix}_lang"),
            "status": null_sentinel(f"{s.prefix}_status"),
            "raw_text": F.col(f"{s.prefix}_ball"),
            "scaled_text": null_sentinel(f"{s.prefix}_ball100"),
        }
        for s in SUBJECTS
    ]


def exam_results(staging: DataFrame) -> DataFrame:
    """One row per person and subject with a status or a scaled score.

    Results are numbered by the hash order of all their fields, so the ids are the
    same however the input is partitioned; equal results get neighbouring ids, and
    however many there are, they are spread over tasks. Staging is read twice.
    """
    keep = [
        canonical_uuid("outid").alias("out_id"),
        parse_date("test_date").alias("test_date"),
        *[null_sentinel(name).alias(name) for name in ("pt_reg_name", "pt_area_name", "pt_ter_name")],
    ]
    rows = unpivot_blocks(staging, keep, _subject_blocks(), ["status", "scaled_text"])
    typed = rows.select(
        "out_id",
        "subject_code",
        "test_date",
        "exam_lang",
        "status",
        parse_score(F.col("raw_text")).alias("raw_score"),
        parse_score(F.col("scaled_text")).alias("scaled_score"),
        is_present(F.col("status")).alias("is_present"),
        "pt_reg_name",
        "pt_area_name",
        "pt_ter_name",
    )
    fields = [F.coalesce(F.col(c).cast("string"), F.lit(ABSENT_FIELD)) for c in typed.columns]
    out_id = F.col("out_id")
    return numbered_by_digest(typed, F.md5(F.concat_ws("|", *fields)), "result_id", {"out_id": (packed_id(out_id), unpacked_id(out_id))}).select("result_id", *typed.columns)


def subject_usage(subjects: DataFrame, results: DataFrame) -> DataFrame:
    """The subject dimension with the number of results that refer to each subject."""
    used = results.groupBy("subject_code").agg(
        F.count("*").alias("result_count"), F.count_if("is_present").alias("attended_count")
    )
    return subjects.join(used, "subject_code", "left").na.fill(0, ["result_count", "attended_count"])
