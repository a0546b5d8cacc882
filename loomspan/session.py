"""Session defaults for tests, the bench and notebooks.

A cluster passes its own session; nothing here changes a session it did not build.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "loomspan", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution on and as many shuffle partitions as threads."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of a data folder. Spark's reader opens the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
