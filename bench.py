"""Time the load and the analytic statements; print one JSON line.

Every table of the load is written once and timed as a query of its own; the
statements then run over the written tables, each timed from plan to last row.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from scoreloom.catalogue import QUERIES, warehouse
from scoreloom.plans.warehouse import TABLES

DIRECTORY = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TIMED = list(QUERIES)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("scoreloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{DIRECTORY}/region.parquet").count()  # start the executors and the file reader
    seconds = {}
    load = warehouse(spark, DIRECTORY)
    for table in TABLES:
        start = time.perf_counter()
        load[table]
        seconds[f"load_{table}"] = round(time.perf_counter() - start, 3)
    for name in TIMED:
        start = time.perf_counter()
        QUERIES[name](spark, DIRECTORY).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps({
            "metric": "total_seconds",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": os.path.basename(os.path.normpath(DIRECTORY)),
            "cpus": int(CPUS),
        })
    )


if __name__ == "__main__":
    main()
