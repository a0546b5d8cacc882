"""Text sinks, an experiment registry, and comparisons of what two runs left behind."""

from __future__ import annotations

import hashlib
import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV files with a header; append adds files to those that are there."""
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields included."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv_report(lines: DataFrame, path: str) -> None:
    """A report of (at, line), such as csv_report() gives, as one text file in order. Reports are short."""
    lines.orderBy("at").select("line").coalesce(1).write.mode("overwrite").text(path)


def file_digests(spark: SparkSession, path: str, head: int = 1 << 20) -> DataFrame:
    """(path, length, sha256, head_md5) of every file under a folder; head_md5 is of the first `head` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5(F.substring("content", 1, head)).alias("head_md5"))


def protocol_hash(config: dict) -> str:
    """SHA-256 of a configuration's canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def config_drift(frozen: dict, now: dict) -> list[tuple[str, str, str]]:
    """(key, frozen value, present value) where two configurations differ, as JSON; a missing key is an empty text."""
    text = lambda d, k: json.dumps(d[k], sort_keys=True) if k in d else ""
    return [(k, text(frozen, k), text(now, k)) for k in sorted({*frozen, *now}) if text(frozen, k) != text(now, k)]


ROLES = ("primary", "sensitivity", "exploratory")


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file of this text, unless it is there: of any number of writers one gets True. The store must create files atomically, as local disks and HDFS do."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            with open(target.toUri().getPath(), "x") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(target, False)
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def register_run(spark: SparkSession, path: str, name: str, role: str, config: dict) -> None:
    """Append a run to a registry table; the role must be known, and there is one primary run a protocol.

    A primary run first claims its protocol, by a file beside the table that only one writer can make.
    """
    if role not in ROLES:
        raise ValueError(f"unknown role; choose one of {', '.join(ROLES)}")
    digest = protocol_hash(config)
    if role == "primary" and not claim(spark, f"{path.rstrip('/')}.claims/{digest}", name):
        raise ValueError("this protocol has a primary run")
    row = [(name, role, digest, json.dumps(config, sort_keys=True))]
    spark.createDataFrame(row, "name string, role string, protocol string, config string").coalesce(1).write.mode("append").parquet(path)


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(value, both, only_a, only_b, different, largest) of two runs' tables of the same rows."""
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_b"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    held = a.select(*keys, *values, F.lit(True).alias("_a")).join(right, on, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def one(v: str):
        gap = F.abs(F.col(v).cast("double") - F.col(f"_{v}").cast("double"))
        apart = both & ((gap > tolerance) | (F.col(v).isNull() != F.col(f"_{v}").isNull()))
        return F.struct(F.count_if(both).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(apart).alias("different"), F.max(F.when(both, gap)).alias("largest")).alias(v)

    return held.agg(*[one(v) for v in values]).unpivot([], values, "value", "_s").select("value", "_s.*")
