"""Conditional aggregates: many filtered measures in one pass over the data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.numeric import score_mean


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def sum_where(value: Column, condition: Column) -> Column:
    """Sum of value where the condition holds, zero when it never does."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def any_where(condition: Column) -> Column:
    """True if any row meets the condition; NULL conditions do not count."""
    return F.bool_or(condition)


def mean_where(score: Column, condition: Column) -> Column:
    return score_mean(F.when(condition, score))


def max_where(value: Column, condition: Column) -> Column:
    """The long-to-wide building block: one output column per condition."""
    return F.max(F.when(condition, value))


def max_code_where(code: Column, codes: list[str], condition: Column) -> Column:
    """Largest code, in text order, among rows that meet the condition.

    Works on the position in the sorted list of known codes: a numeric maximum
    can be hash-aggregated in place, a text maximum would need a sort.
    """
    ordered = F.array(*[F.lit(c) for c in sorted(codes)])
    position = F.max(F.when(condition, F.nullif(F.array_position(ordered, code), F.lit(0))))
    return F.try_element_at(ordered, position.cast("int"))
