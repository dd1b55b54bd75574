"""python -m scoreloom RAW_FILES OUTPUT_FOLDER: load raw files, check the load, write all results."""

import sys

from pyspark.sql import SparkSession

from scoreloom.plans.publish import write_results
from scoreloom.plans.warehouse import Warehouse
from scoreloom.sources.staging_csv import read_staging


def main(raw: str, folder: str) -> None:
    spark = SparkSession.builder.appName("scoreloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name, path in write_results(Warehouse(spark, lambda: read_staging(spark, raw)), folder).items():
        print(name, path)


if __name__ == "__main__":
    main(*sys.argv[1:])
