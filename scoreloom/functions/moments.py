"""Deviation, correlation and slope of decimals from exact sums of whole numbers, the same for any partitioning.

A value counts in units of its last place. Products are summed as two numbers, above and below 10^18, which Spark merges like any
sums. Before anything is squared away the sums are centred on the whole number next to the mean, still exactly; a double
appears only when the centred sums are put together, and there nothing cancels. Room: values of 18 digits, 10^16 rows.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE, _UNIT, _COUNT, _LIMB = "decimal(38,0)", "decimal(18,0)", "decimal(16,0)", "decimal(19,0)"


def _base() -> Column:
    return F.lit(Decimal(10**18))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def in_units(value: Column, places: int) -> Column:
    """The value in units of its last place; an error where it has more places than that."""
    exact = value * F.lit(Decimal(10**places))
    units = exact.cast(_UNIT)
    return F.when(value.isNull() | (units == exact), units).otherwise(F.raise_error(F.lit(f"a value has more than {places} places")).cast(_UNIT))


def _low(x: Column) -> Column:
    return x % _base()


def _high(x: Column) -> Column:
    return ((x - x % _base()) / _base()).cast("decimal(20,0)")


def _sums(names: str, values: list[Column], n: Column) -> list[Column]:
    """Sums of the values, and two limbs of the sums of all products of two of them."""
    out = [F.sum((v.cast(_UNIT) * n).cast("decimal(34,0)")).cast(_WIDE).alias(f"s{a}") for a, v in zip(names, values, strict=True)]
    for i, (a, v) in enumerate(zip(names, values, strict=True)):
        for b, w in list(zip(names, values, strict=True))[i:]:
            product = v * w
            out.append(F.sum((_high(product) * n).cast("decimal(36,0)")).cast(_WIDE).alias(f"h{a}{b}"))
            out.append(F.sum((_low(product) * n).cast("decimal(36,0)")).cast(_WIDE).alias(f"l{a}{b}"))
    return out


def _centred(high: Column, low: Column, middle: Column, times: Column, less: Column) -> Column:
    """high and low limb of a sum of products, less middle * times and `less`, as a double."""
    above, below = _high(times), _low(times)
    lower = low - (middle * below).cast(_WIDE) - less
    upper = high - (middle * above).cast(_WIDE)
    half = F.lit(Decimal(10**18 // 2))

    def joined(limbs: Column) -> Column:
        # the lower one within half a unit of the upper one either way, so that the two never cancel
        rest = _low(limbs["lower"])
        rest = rest - F.when(rest >= half, _base()).when(rest < -half, -_base()).otherwise(F.lit(Decimal(0)))
        carried = limbs["upper"] + ((limbs["lower"] - rest) / _base()).cast(_WIDE)
        return carried.cast("double") * 1e18 + rest.cast("double")

    return _let(F.struct(upper.cast(_WIDE).alias("upper"), lower.cast(_WIDE).alias("lower")), joined)


def _spread(g: Column, a: str) -> Column:
    """Sum of squared distances from the mean: from the whole number next to it, less the rest's square."""
    middle, rest, total = g[f"m{a}"], g[f"r{a}"], g[f"s{a}"]
    around = _centred(g[f"h{a}{a}"], g[f"l{a}{a}"], middle, (total + rest).cast(_WIDE), F.lit(Decimal(0)))
    return around - rest.cast("double") * rest.cast("double") / g["n"].cast("double")


def _joint(g: Column) -> Column:
    around = _centred(g["hxy"], g["lxy"], g["mx"], g["sy"], (g["my"] * g["rx"]).cast(_WIDE))
    return around - g["rx"].cast("double") * g["ry"].cast("double") / g["n"].cast("double")


def _with_middles(names: str, summed: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of the sums with the whole number next to each mean, and what the sum is beyond it; NULL without values."""

    def completed(g: Column) -> Column:
        middles = {a: F.round(g[f"s{a}"] / g["n"]).cast(_LIMB) for a in names}
        fields = [g["n"].alias("n")]
        for a, m in middles.items():
            fields += [g[f"s{a}"].alias(f"s{a}"), m.alias(f"m{a}"), (g[f"s{a}"] - (m * g["n"]).cast(_WIDE)).cast("decimal(18,0)").alias(f"r{a}")]
        for i, a in enumerate(names):
            for b in names[i:]:
                fields += [g[f"h{a}{b}"].alias(f"h{a}{b}"), g[f"l{a}{b}"].alias(f"l{a}{b}")]
        return _let(F.struct(*fields), use)

    return _let(summed, lambda g: F.when(g["n"] > 0, completed(g)))


def _weights(n: Column | None, *values: Column) -> Column:
    """How often a row counts: not at all where a value is NULL."""
    known = values[0].isNotNull()
    for v in values[1:]:
        known = known & v.isNotNull()
    return F.when(known, n if n is not None else F.lit(1)).cast(_COUNT)


def sample_stddev(value: Column, places: int, n: Column | None = None) -> Column:
    """Aggregate: sample standard deviation of a decimal with so many places, each value taken n times; NULL for fewer than two."""
    x, weight = in_units(value, places), _weights(n, value)
    summed = F.struct(F.sum(weight).cast(_COUNT).alias("n"), *_sums("x", [x], weight))
    variance = lambda g: F.when(g["n"] > 1, _spread(g, "x") / (g["n"] - 1).cast("double"))
    return F.sqrt(_with_middles("x", summed, variance)) / float(10**places)


def _two(x: Column, x_places: int, y: Column, y_places: int, use: Callable[[Column], Column]) -> Column:
    weight = _weights(None, x, y)
    known = weight.isNotNull()
    xs, ys = F.when(known, in_units(x, x_places)), F.when(known, in_units(y, y_places))
    summed = F.struct(F.sum(weight).cast(_COUNT).alias("n"), *_sums("xy", [xs, ys], weight))
    return _with_middles("xy", summed, use)


def corr(x: Column, x_places: int, y: Column, y_places: int) -> Column:
    """Aggregate: correlation over rows that have both; NULL where either does not vary."""

    def ratio(g: Column) -> Column:
        both = F.sqrt(_spread(g, "x")) * F.sqrt(_spread(g, "y"))
        return F.when(both > 0, _joint(g) / both)

    return _two(x, x_places, y, y_places, ratio)


def slope(y: Column, y_places: int, x: Column, x_places: int) -> Column:
    """Aggregate: slope of the regression of y on x over rows that have both; NULL where x does not vary."""
    per_unit = _two(x, x_places, y, y_places, lambda g: F.when(_spread(g, "x") > 0, _joint(g) / _spread(g, "x")))
    return per_unit * float(10**x_places) / float(10**y_places)
