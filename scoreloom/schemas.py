"""Declared schemas. Nothing is ever inferred from data."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom import fixed_values as fv


class Subject(NamedTuple):
    code: str
    name: str
    mandatory: bool
    prefix: str
    language: str | None

    @property
    def fields(self) -> list[str]:
        """Raw columns of this subject's block, in file order."""
        parts = ["block", "status", "ball100", "ball"]
        if self.language is None:
            parts.insert(1, "lang")
        return [f"{self.prefix}_{part}" for part in parts]


SUBJECTS = tuple(Subject(*row) for row in fv.SUBJECT_ROWS)
MANDATORY = [s.code for s in SUBJECTS if s.mandatory]
ELECTIVE = [s.code for s in SUBJECTS if not s.mandatory]

PERSON_FIELDS = [
    "outid", "birth", "sex_type_name", "reg_name", "area_name", "ter_name",
    "reg_type_name", "ter_type_name",
]
INSTITUTION_FIELDS = [
    "eo_name", "eo_type_name", "eo_reg_name", "eo_area_name", "eo_ter_name",
    "eo_parent", "eo_edrpou", "eo_edeboid",
]
SESSION_FIELDS = ["test", "test_date"]
CENTRE_FIELDS = ["pt_reg_name", "pt_area_name", "pt_ter_name"]
STAGING_FIELDS = [
    *PERSON_FIELDS,
    *INSTITUTION_FIELDS,
    *SESSION_FIELDS,
    *(field for subject in SUBJECTS for field in subject.fields),
    *CENTRE_FIELDS,
]
STAGING = T.StructType([T.StructField(name, T.StringType()) for name in STAGING_FIELDS])

SCORE = T.DecimalType(5, 2)

# Declared text widths of the star tables, checked by plans.quality.
TEXT_WIDTHS = {
    "subjects": {"subject_code": 10, "subject_name": 100},
    "institutions": {
        "edebo_id": 50, "edrpou": 50, "institution_type": 150,
        "reg_name": 100, "area_name": 100, "ter_name": 100,
    },
    "participants": {
        "gender": 15, "participant_status": 100, "ter_type": 50,
        "reg_name": 100, "area_name": 100, "ter_name": 100,
    },
    "exam_results": {
        "subject_code": 10, "exam_lang": 50, "status": 100,
        "pt_reg_name": 100, "pt_area_name": 100, "pt_ter_name": 100,
    },
}
PRIMARY_KEYS = {
    "subjects": "subject_code",
    "institutions": "institution_id",
    "participants": "out_id",
    "exam_results": "result_id",
}
# child table, child column, parent table, parent column
FOREIGN_KEYS = [
    ("participants", "institution_id", "institutions", "institution_id"),
    ("exam_results", "out_id", "participants", "out_id"),
    ("exam_results", "subject_code", "subjects", "subject_code"),
]
REQUIRED = {
    "subjects": ["subject_code", "subject_name", "is_mandatory"],
    "institutions": ["institution_id", "institution_name"],
    "participants": ["out_id"],
    "exam_results": ["result_id", "out_id", "subject_code"],
}


def subjects_df(spark: SparkSession) -> DataFrame:
    """The subject dimension, seeded from the declared list; a subject without a flag counts as elective."""
    rows = [
        F.struct(F.lit(s.code).alias("subject_code"), F.lit(s.name).alias("subject_name"), F.lit(bool(s.mandatory)).alias("is_mandatory"))
        for s in SUBJECTS
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
