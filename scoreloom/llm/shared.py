"""Tables written to the folder that all executors and the driver share, and the size of batches that workers get."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from scoreloom.sources.scratch import folder, fresh, written

__all__ = ["bounded_batches", "folder", "fresh", "written"]

#: Bytes of an Arrow batch. Spark's own limit counts rows first, and ten thousand texts may be long ones.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let the session send workers no batches above BATCH_BYTES; a smaller limit that is set stays."""
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(_LIMIT))
    if now is None or int(now[1]) > BATCH_BYTES:
        spark.conf.set(_LIMIT, BATCH_BYTES)
