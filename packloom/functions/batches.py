"""Sizes of what a Python worker holds."""

from __future__ import annotations

from pyspark.sql import SparkSession

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: rows of whole texts that one Arrow batch holds at most
TEXT_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``TEXT_ROWS`` where they are more: rows here are whole texts."""
    if not 0 < int(spark.conf.get(KEY)) <= TEXT_ROWS:
        spark.conf.set(KEY, TEXT_ROWS)
