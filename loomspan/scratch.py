"""Tables and files written to the shared folder that the cluster names.

Operators cut their lineage by writing an intermediate table here and reading it again, so a lost executor costs a
re-read and never a recomputation from the source.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """URI of the shared folder: spark.checkpoint.dir, or a temporary folder where that is unset (tests, one machine)."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"loomspan-{spark.sparkContext.applicationId}")
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{root(spark)}/loomspan/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return a scan of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables that materialize() made, or paths that new_path() gave."""
    for t in tables:
        paths = [t] if isinstance(t, str) else {f.rpartition("/")[0] for f in t.inputFiles()}
        for p in paths:
            if "/loomspan/" in p:
                where = spark._jvm.org.apache.hadoop.fs.Path(p)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
