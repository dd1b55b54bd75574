"""A delivery with faults of every kind, derived from a sound one by arithmetic on its keys.

The faults are expressions that every SQL engine reads alike, so that other engines can derive the same delivery.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom import schemas

NOBODY = "00000000-0000-4000-8000-000000000000"


def _long_texts(table: str, condition: str, first: int) -> list[tuple[str, str, str]]:
    """For each column with a width, a text that is one character too long, on rows of their own."""
    return [(column, condition.format(first + k), f"repeat('x', {width + 1})") for k, (column, width) in enumerate(schemas.TEXT_WIDTHS[table].items())]


def _score_fields() -> list[str]:
    return [f"{s.prefix}_{part}" for s in schemas.SUBJECTS for part in ("ball100", "ball")]


_INSTITUTION, _PERSON, _RESULT = "institution_id % 101 = {}", "substr(out_id, 1, 2) = '{:02x}'", "result_id % 1009 = {}"

#: By table: column, rows that are spoiled, what the column then holds.
FAULTS: dict[str, list[tuple[str, str, str]]] = {
    "staging": [(field, f"substr(outid, 1, 2) = '{k:02x}'", "'1x'") for k, field in enumerate(_score_fields())],
    "institutions": [
        ("institution_id", _INSTITUTION.format(1), "CAST(NULL AS BIGINT)"),
        ("institution_id", _INSTITUTION.format(3), "institution_id + 1"),
        ("institution_name", _INSTITUTION.format(5), "CAST(NULL AS VARCHAR(9))"),
        *_long_texts("institutions", _INSTITUTION, 6),
    ],
    "participants": [
        ("out_id", _PERSON.format(0), f"'{NOBODY[:-1]}' || substr(out_id, 3, 1)"),
        ("out_id", _PERSON.format(1), "CAST(NULL AS VARCHAR(9))"),
        ("out_id", _PERSON.format(2), "'x' || substr(out_id, 2, 35)"),
        ("institution_id", _PERSON.format(3), "CAST(-1 AS BIGINT)"),
        *_long_texts("participants", _PERSON, 4),
    ],
    "exam_results": [
        ("result_id", _RESULT.format(1), "CAST(NULL AS BIGINT)"),
        ("result_id", _RESULT.format(3), "result_id + 1"),
        ("out_id", _RESULT.format(5), "CAST(NULL AS VARCHAR(9))"),
        ("out_id", _RESULT.format(6), f"'{NOBODY[:-1]}z'"),
        ("subject_code", _RESULT.format(7), "CAST(NULL AS VARCHAR(9))"),
        ("subject_code", _RESULT.format(8), "'Nope'"),
        *_long_texts("exam_results", _RESULT, 9),
    ],
}
#: Subjects beside the declared ones: code, name, whether mandatory.
FURTHER_SUBJECTS: list[tuple[str | None, str | None, bool | None]] = [
    ("Twice", "once", False),
    ("Twice", "again", False),
    (None, "without a code", False),
    ("Nameless", None, False),
    ("Flagless", "without a flag", None),
    ("x" * 11, "with a long code", False),
    ("Long", "x" * 101, False),
]


def spoiled_column(table: str, column: str) -> str | None:
    """The column with its faults as an expression; None where it has none."""
    cases = [f"WHEN {rows} THEN {value}" for name, rows, value in FAULTS.get(table, []) if name == column]
    return f"CASE {' '.join(cases)} ELSE {column} END" if cases else None


def spoiled(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with faults; `subjects` gains the further ones."""
    made = {}
    for name, df in tables.items():
        changed = [(c, spoiled_column(name, c)) for c in df.columns]
        made[name] = df.select(*[F.expr(e).alias(c) if e else F.col(c) for c, e in changed])
    further = made["subjects"].sparkSession.createDataFrame(FURTHER_SUBJECTS, made["subjects"].schema)
    return {**made, "subjects": made["subjects"].unionByName(further)}
