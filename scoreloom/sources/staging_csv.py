"""The raw wide file: separated text, read as text only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoreloom import fixed_values as fv
from scoreloom.schemas import STAGING


def read_staging(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read raw files into the all-text staging shape.

    An unquoted empty field is NULL, a quoted one is empty text, and the
    missing-value text is kept as it stands: later steps tell the three apart.
    Malformed rows raise, on narrow reads too, which is why column pruning is off
    for this reader. multi_line allows line breaks inside quotes at the price of
    unsplittable files.
    """
    return (
        spark.read.schema(STAGING)
        .option("header", True)
        .option("sep", fv.FIELD_SEPARATOR)
        .option("quote", fv.QUOTE)
        .option("escape", fv.QUOTE)
        .option("encoding", fv.ENCODING)
        .option("mode", "FAILFAST")
        .option("nullValue", "\u0001")
        .option("columnPruning", False)
        .option("enforceSchema", True)
        .option("multiLine", multi_line)
        .csv(path)
    )


def write_staging(df: DataFrame, path: str) -> None:
    """Write staging rows in the raw file format that read_staging accepts."""
    (
        df.select(*STAGING.fieldNames())
        .write.option("header", True)
        .option("sep", fv.FIELD_SEPARATOR)
        .option("quote", fv.QUOTE)
        .option("escape", fv.QUOTE)
        .option("nullValue", "")
        .option("emptyValue", '""')
        .option("encoding", fv.ENCODING)
        .csv(path)
    )
