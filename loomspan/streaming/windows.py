"""Streaming forms of the panel's daily aggregates. The panel itself is batch; these are additions for live feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily_windows(events: DataFrame, entity: str, ts: str, value: str, late: str = "2 days") -> DataFrame:
    """(entity, day, n, total) by tumbling days, closed once the watermark has passed them; batch frames give all days."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if events.isStreaming else timed
    out = timed.groupBy(F.window("_ts", "1 day"), F.col(entity).alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select("entity", F.to_date("window.start").alias("day"), "n", "total")


def sessions(events: DataFrame, entity: str, ts: str, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(entity, start, end, n): runs of events with no gap as long as `gap`."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if events.isStreaming else timed
    out = timed.groupBy(F.session_window("_ts", gap), F.col(entity).alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("entity", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
