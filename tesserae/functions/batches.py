"""The size of what Python workers get at once."""

from __future__ import annotations

from pyspark.sql import SparkSession


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2 MB, unless the session sets them: a Python worker then holds little more than that of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(2 << 20))
