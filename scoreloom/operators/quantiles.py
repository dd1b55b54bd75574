"""Exact interpolated quantiles of values with many distinct levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.sources.scratch import written


def _wanted_ranks(counts: DataFrame, keys: list[str], order: str, ps: list[float]) -> DataFrame:
    """Rows of (keys, order, n) that hold a wanted rank: the place of the quantile, the side, rows before and the fraction."""
    group = W.partitionBy(*keys)
    before = F.sum("n").over(group.orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    ranked = counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_all": F.sum("n").over(group)})
    places = []
    for place, p in enumerate(ps):
        exact = F.lit(float(p)) * (F.col("_all") - 1)
        for side, rank in (("low", F.floor(exact)), ("high", F.ceil(exact))):
            places.append(
                F.struct(
                    F.lit(place).alias("place"),
                    F.lit(side).alias("side"),
                    rank.cast("long").alias("rank"),
                    (exact - F.floor(exact)).alias("part"),
                )
            )
    wanted = ranked.withColumn("_w", F.explode(F.array(*places))).select(*keys, order, "n", "_before", "_w.*")
    return wanted.filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("n")))


def _interpolated(found: DataFrame, keys: list[str], value: str, ps: list[float], name: str) -> DataFrame:
    """One row per group with the array of its quantiles, from the values at the wanted ranks."""
    at = lambda place, side: F.max(F.when((F.col("place") == place) & (F.col("side") == side), F.col(value)))
    part = lambda place: F.max(F.when(F.col("place") == place, F.col("part")))
    quantile = [at(k, "low") + (at(k, "high") - at(k, "low")) * part(k) for k in range(len(ps))]
    return found.groupBy(*keys).agg(F.array(*quantile).alias(name))


def group_quantiles(counts: DataFrame, keys: list[str], ps: list[float], name: str = "q") -> DataFrame:
    """Quantiles of value counts (keys, value, n) by a running count in each group.

    For many groups: the running count sorts and spills, so no group has to fit in memory.
    """
    return _interpolated(_wanted_ranks(counts, keys, "value", ps), keys, "value", ps, name)


#: Bits of the code that one level decides; a level counts at most 2 ** BITS values a wanted range.
BITS = 16
#: Wanted ranges up to this number of rows are sent to all tasks; more are joined by key.
SMALL = 100_000


def order_code(value: Column) -> Column:
    """A double as a whole number of 64 bits with the same order; equal only for equal values. NaN is the largest, -0.0 is 0.0."""
    size = F.abs(value)
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)).cast("double")
    power = F.pow(F.lit(2.0), guess)
    # the logarithm is rounded: next to a power of two it can name the neighbour
    exponent = guess + F.when((size >= power * 2) & (guess < 1023), 1.0).when((size < power) & (guess > -1022), -1.0).otherwise(0.0)
    fraction = (size / F.pow(F.lit(2.0), exponent) * float(1 << 52)).cast("long")
    finite = (exponent.cast("long") + 1022) * F.lit(1 << 52) + fraction
    code = (
        F.when(F.isnan(value), F.lit((2047 << 52) + 1))
        .when(size == float("inf"), F.lit(2047 << 52))
        .when(size == 0, F.lit(0).cast("long"))
        .otherwise(finite)
    )
    return F.when(value < 0, -code).otherwise(code)


def _ranges(rows: DataFrame, keys: list[str], within: list[str], tallies: list[Column]) -> DataFrame:
    """Rows counted by the range `_range`, with the rows before it in its parent (keys, within) for each tally."""
    counts = rows.groupBy(*keys, *within, "_range").agg(
        F.array(*tallies).alias("n"), F.min("_value").alias("_low"), F.max("_value").alias("_high")
    )
    group = W.partitionBy(*keys, *within)
    earlier = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(F.col("n")[i]).over(earlier), F.lit(0)) for i in range(len(tallies))]
    every = [F.sum(F.col("n")[i]).over(group) for i in range(len(tallies))]
    return counts.withColumns({"_before": F.array(*before), "_all": F.array(*every)})


def _holding(ranges: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """The ranges that hold a wanted rank, which then counts from the range's first row."""
    found = ranges.select(*keys, "_range", "_low", "_high", "n", "_before", F.inline(wanted))
    before, held = F.col("_before")[F.col("tally")], F.col("n")[F.col("tally")]
    inside = (F.col("rank") >= before) & (F.col("rank") < before + held)
    return found.filter(inside).select(*keys, "_range", "_low", "_high", "tally", "place", "side", (F.col("rank") - before).alias("rank"), "part")


def large_quantiles(
    df: DataFrame, keys: list[str], value: Column, ps: list[float], name: str = "q", where: dict[str, Column] | None = None
) -> DataFrame:
    """Quantiles of few groups that may hold almost all rows, of any doubles.

    Values are read as numbers of 64 bits with the same order. Each level counts the next 16 bits of the values
    that can still be a wanted one, for all groups and ranks at once, so a task never sees more of a group than its
    share of rows and then at most 65,536 counts. It ends when each wanted range holds one value, after four levels at the
    latest. NULL values do not count. `where` gives one array for each named condition instead, all from the same passes.
    """
    conditions = where or {name: F.lit(True)}
    flags = {f"_in{i}": condition for i, condition in enumerate(conditions.values())}
    tallies = [F.count_if(flag) for flag in flags]
    double = value.cast("double")
    rows = df.filter(double.isNotNull()).select(*keys, double.alias("_value"), *[c.alias(flag) for flag, c in flags.items()])
    rows = rows.withColumn("_code", order_code(F.col("_value")))

    first = _ranges(rows.withColumn("_range", F.shiftright("_code", 64 - BITS)), keys, [], tallies)
    places = []
    for tally in range(len(conditions)):
        for place, p in enumerate(ps):
            exact = F.lit(float(p)) * (F.col("_all")[tally] - 1)
            for side, rank in (("low", F.floor(exact)), ("high", F.ceil(exact))):
                named = {"tally": F.lit(tally), "place": F.lit(place), "side": F.lit(side), "rank": rank.cast("long"), "part": exact - F.floor(exact)}
                places.append(F.struct(*[c.alias(n) for n, c in named.items()]))
    wanted = written(_holding(first, keys, F.array(*places)), "wanted")
    for level in range(2, 64 // BITS + 1):
        left = wanted.agg(F.count("*").alias("rows"), F.count_if(F.col("_low") < F.col("_high")).alias("open")).first()
        if not left["open"]:
            break
        held = wanted.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_parent")).agg(
            F.collect_list(F.struct("tally", "place", "side", "rank", "part")).alias("_wanted")  # some for each quantile
        )
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        same.append(F.shiftright("_code", 64 - BITS * (level - 1)) == F.col("_parent"))
        inside = rows.join(F.broadcast(held) if left["rows"] <= SMALL else held, reduce(Column.__and__, same))
        inside = inside.withColumn("_range", F.shiftright("_code", 64 - BITS * level))
        ranges = _ranges(inside, keys, ["_parent", "_wanted"], tallies)
        wanted = written(_holding(ranges, keys, F.col("_wanted")), "wanted")

    at = lambda t, k, side: F.max(F.when((F.col("tally") == t) & (F.col("place") == k) & (F.col("side") == side), F.col("_high")))
    part = lambda t, k: F.max(F.when((F.col("tally") == t) & (F.col("place") == k), F.col("part")))
    arrays = [
        F.array(*[at(t, k, "low") + (at(t, k, "high") - at(t, k, "low")) * part(t, k) for k in range(len(ps))]).alias(label)
        for t, label in enumerate(conditions)
    ]
    return wanted.groupBy(*keys).agg(*arrays)
