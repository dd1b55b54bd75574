"""Cleaning and typing of raw text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom import fixed_values as fv
from scoreloom.schemas import SCORE


def null_sentinel(col: str) -> Column:
    """The column with the missing-value text turned into NULL."""
    return F.nullif(F.col(col), F.lit(fv.MISSING))


def has_value(col: str) -> Column:
    """True where the raw text is neither NULL nor the missing-value text."""
    return F.col(col).isNotNull() & (F.col(col) != fv.MISSING)


def cascade_key(codes: list[str], parts: list[str]) -> Column:
    """First present code, else the raw parts joined (missing-value texts included)."""
    joined = F.concat_ws(fv.KEY_SEPARATOR, *parts)
    return F.coalesce(*[null_sentinel(c) for c in codes], joined)


def parse_score(col: Column) -> Column:
    """Decimal-comma text to a score; malformed or oversized text raises under ANSI mode."""
    text = F.replace(F.nullif(col, F.lit(fv.MISSING)), F.lit(","), F.lit("."))
    return F.trim(text).cast(SCORE)


def try_parse_score(col: Column) -> Column:
    """As parse_score, but NULL for text that is not a score (for quality checks)."""
    text = F.replace(F.nullif(col, F.lit(fv.MISSING)), F.lit(","), F.lit("."))
    return F.trim(text).try_cast(SCORE)


def parse_date(col: str) -> Column:
    return F.to_date(null_sentinel(col), fv.DATE_PATTERN)


def canonical_uuid(col: str) -> Column:
    """Trimmed, lower-case identifier; NULL for the missing-value text."""
    return F.nullif(F.lower(F.trim(F.col(col))), F.lit(fv.MISSING))


def is_uuid(col: Column) -> Column:
    return col.rlike(fv.UUID_PATTERN)


#: Before the bytes of an identifier of another form, so that they are longer than 16.
_OTHER_FORM = "00" * 17


def packed_id(col: Column) -> Column:
    """An identifier in fewer bytes, to be dealt or grouped by: 16 for a canonical UUID; equal only for equal texts."""
    digits = F.unhex(F.replace(col, F.lit("-"), F.lit("")))
    return F.when(is_uuid(col), digits).otherwise(F.concat(F.unhex(F.lit(_OTHER_FORM)), col.cast("binary")))


def unpacked_id(col: Column) -> Column:
    """The text of a packed identifier."""
    digits = F.lower(F.hex(col))
    parts = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    other = F.substring(col, len(_OTHER_FORM) // 2 + 1, 1 << 30).cast("string")
    return F.when(F.length(col) == 16, F.concat_ws("-", *parts)).when(col.isNotNull(), other)


def is_present(status: Column) -> Column:
    """False for any spelling of "did not appear"; NULL when there is no status."""
    return ~status.ilike(fv.ABSENT_PATTERN)


def strip_town_prefix(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, fv.TOWN_PREFIX, ""))
