"""Compare rows with a one-row benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row.

    The benchmark becomes a scalar subquery: Spark runs it once and hands the
    values to the tasks as constants, so there is no join at all.
    """
    row = benchmark.select(F.struct(*benchmark.columns).alias("_row")).scalar()
    return df.withColumns({name: row[name] for name in benchmark.columns})
