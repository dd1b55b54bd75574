"""Exact numerics: rounding, means, shares, quantiles and dispersion.

Scores are decimals with two places. Sums over them stay integral (Spark sums a
narrow decimal as a long), so results do not depend on task order, and a double
only appears at the very end of an interpolated quantile.

The weighted forms read a table of (group, value, n) as made by
operators.value_counts: one row per distinct value with its row count. A hot
group is then spread over its values before any single task sees it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions import moments

# A mean held per person: wide enough to be exact for every comparison made on it.
MEAN = "decimal(18,12)"
COUNT = "decimal(18,0)"


def half_up(col: Column, places: int) -> Column:
    """Round a decimal half away from zero."""
    return F.round(col, places)


def pg_round(col: Column, places: int) -> Column:
    """Round a double as decimal arithmetic would: settle binary noise first, then half up."""
    return F.round(settled(col), places)


def settled(col: Column) -> Column:
    """A double as a decimal without binary noise, fit for strict comparison."""
    return col.cast("decimal(18,10)")


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return a / F.nullif(b, F.lit(0))


def exact_ratio(part: Column, whole: Column) -> Column:
    """part / whole of whole numbers from zero up, fit to be rounded half up to as many as eight places.

    Nine places of the quotient are taken by whole division, and a tenth is 1 where anything is left, so a quotient
    just below a half never becomes one. NULL when whole is zero.
    """

    left, d = part.cast("decimal(33,0)"), F.nullif(whole.cast("decimal(33,0)"), F.lit(0))
    quotient = ((left - left % d) / d).cast("decimal(20,0)")
    for step in range(1, 4):
        left = left % d * 1000
        quotient = quotient + ((left - left % d) / d).cast("decimal(3,0)") * F.lit(Decimal(1).scaleb(-3 * step))
    rest = F.when(left % d == 0, F.lit(Decimal("0E-10"))).otherwise(F.lit(Decimal("1E-10")))
    return (quotient + rest).cast("decimal(30,10)")


def pct(part: Column, whole: Column, places: int) -> Column:
    """100 * part / whole of two counts, exactly rounded; NULL when whole is zero."""
    return half_up(exact_ratio(F.lit(100) * part.cast("decimal(20,0)"), whole), places)


def score_mean(col: Column, as_type: str = "decimal(8,2)") -> Column:
    """Aggregate: exact mean of a score column.

    The input type must have at most eight digits: Spark then sums longs and the
    total has room for 10^13 scores.
    """
    return safe_div(F.sum(col.cast(as_type)), F.count(col))


def exact_avg(col: Column) -> Column:
    """Aggregate or window: mean of any decimal without an early rounding."""
    return F.avg(col.cast("decimal(20,10)"))


def weighted_mean(value: Column, n: Column) -> Column:
    """Aggregate over value counts: mean of value, each taken n times; NULL values carry no weight."""
    total = F.sum(value.cast(MEAN) * n.cast(COUNT))
    return safe_div(total, F.sum(F.when(value.isNotNull(), n)))


def percentile_cont(
    value: Column,
    p: float | list[float],
    n: Column | None = None,
    where: Column | None = None,
) -> Column:
    """Aggregate: exact interpolated quantile(s) of value, each value taken n times.

    The interpolation is in double in any case; converting before Spark collects
    the distinct values keeps its tables small and quick to merge.
    """
    if where is not None:
        value = F.when(where, value)
    return F.percentile(value.cast("double"), p, n if n is not None else F.lit(1))


def iqr(quartiles: Column, places: int) -> Column:
    """Spread of a [q1, ..., q3] array, rounded only after the subtraction."""
    return pg_round(F.element_at(quartiles, -1) - F.element_at(quartiles, 1), places)


def sample_stddev(value: Column, n: Column, places: int = 2) -> Column:
    """Aggregate over value counts of a decimal with so many places: exact sample standard deviation.

    NULL for fewer than two values; an error where a value has more places.
    """
    return moments.sample_stddev(value, places, n)


def cv(value: Column, n: Column, places: int) -> Column:
    """Aggregate over value counts: coefficient of variation."""
    ratio = safe_div(sample_stddev(value, n), weighted_mean(value, n).cast("double"))
    return pg_round(ratio, places)
