"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def version(spark: SparkSession, directory: str, name: str) -> int:
    """When a table's file or folder was last changed, in whatever store Spark reads it from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
