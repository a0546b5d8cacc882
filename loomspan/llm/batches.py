"""Batch size of texts on their way to Python tasks."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def keep_small(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound Arrow batches by bytes, unless the session has bounded them lower already.

    Texts differ in length a hundred-thousandfold, so a bound on rows says little about a task's memory.
    """
    now = spark.conf.get(_BYTES).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= size:
        spark.conf.set(_BYTES, str(size))
