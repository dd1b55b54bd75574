"""Result export."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_result(df: DataFrame, path: str) -> None:
    """Write a result as CSV with a header, every field quoted and NULL as an empty quoted field."""
    df.write.option("header", True).option("quoteAll", True).option("nullValue", "").option("emptyValue", "").csv(path)
