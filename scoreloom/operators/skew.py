"""Joins on a key that may hold a large share of the rows, or none, and with tables that look smaller than they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that the sketch may report, and counters it keeps.
REPORTED, COUNTERS = 64, 4096
#: A value is heavy from this many fair shares of a task on, and is dealt in this many pieces for each task.
SHARES, PIECES = 1.0, 4


def dealt(df: DataFrame) -> DataFrame:
    """One side of a join that grows with the input: both sides are dealt by key, this one is never sent whole to the driver and every task.

    Spark takes a stored table's compressed files for its size, and what is exploded from a row for no more than the row. A side
    that seems to be below the broadcast threshold can be a hundred times as large when it is gathered.
    """
    return df.hint("merge")


def heavy_values(df: DataFrame, key: str) -> list:
    """Values of `key` that hold more rows than a task's fair share, at most REPORTED of them; by one pass of a mergeable sketch."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = df.select(F.col(key).alias("k")).agg(F.expr(f"approx_top_k(k, {REPORTED}, {COUNTERS})").alias("top"), F.count("k").alias("rows")).first()
    return [t["item"] for t in row["top"] or [] if t["item"] is not None and t["count"] * tasks > SHARES * row["rows"]]


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", heavy: list | None = None) -> DataFrame:
    """Join rows to a table with few rows for each key, "inner" or "left"; all columns of both.

    Rows of a heavy key are dealt over all tasks, and that key's rows of the right side are repeated for each; all other keys
    are joined as they are, neither side being broadcast. Rows without a key match nothing: they go past the join, or are dropped by an inner one.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    known = left.filter(F.col(left_key).isNotNull())
    heavy = heavy_values(known, left_key) if heavy is None else heavy
    if heavy:
        pieces = PIECES * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def is_heavy(key: str) -> Column:
            return F.col(key).isin(heavy)

        known = known.withColumn("_piece", F.when(is_heavy(left_key), F.monotonically_increasing_id() % pieces).otherwise(0).cast("int"))
        copies = F.when(is_heavy(right_key), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))
        spread = right.withColumn("_right_piece", F.explode(copies))
        joined = known.join(dealt(spread), (F.col(left_key) == F.col(right_key)) & (F.col("_piece") == F.col("_right_piece")), how).drop("_piece", "_right_piece")
    else:
        joined = known.join(dealt(right), F.col(left_key) == F.col(right_key), how)
    if how == "inner":
        return joined
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
    return joined.unionByName(left.filter(F.col(left_key).isNull()).select(*left.columns, *absent))
