"""Readers and writers with the habits the panel needs: explicit schemas, clean nulls, idempotent sinks and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column."""
    inf = float("inf")
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == inf)
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def read_csv(spark: SparkSession, path: str, schema: str, upper: bool = False) -> DataFrame:
    """CSV files (gzip too) with a header and a given schema; upper gives upper-case column names."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.toDF(*[c.upper() for c in df.columns]) if upper else df


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files that hold arrays of records; rows that repeat whole are kept once."""
    return spark.read.schema(schema).option("multiLine", True).json(path).dropDuplicates()


def typed_records(records: DataFrame, kinds: dict[str, str], year: str, first: int, last: int) -> DataFrame:
    """Text records with some columns cast (null where a text does not fit), of the years asked for, repeats left out."""
    typed = records.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items()})
    return typed.where(F.col(year).between(first, last)).dropDuplicates()


def by_precedence(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row a key from the first source that has it, and the number of that source from 1; sources come best first."""
    out = sources[0].withColumn("source_rank", F.lit(1))
    for k, df in enumerate(sources[1:], 2):
        out = out.unionByName(df.withColumn("source_rank", F.lit(k)), allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (*keys, "source_rank")]
    best = out.groupBy(*keys).agg(F.min(F.struct("source_rank", *rest)).alias("_b"))
    return best.select(*keys, "_b.*")


def read_matching(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The columns of a Parquet table that another table has."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in df.columns if c in set(like.columns)])


def read_all(spark: SparkSession, *paths: str) -> DataFrame:
    """The union of Parquet tables by column name; columns that a table lacks are null."""
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def write_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Write df by partition keys; only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def missing_work(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of wanted whose keys are not done yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def guarded_overwrite(df: DataFrame, path: str) -> bool:
    """Replace a table unless that would leave fewer rows; says whether it did."""
    from pyspark.errors import AnalysisException

    spark = df.sparkSession
    try:
        before = spark.read.parquet(path).count()
    except AnalysisException:
        before = 0
    if df.count() < before:
        return False
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return True


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def artifact_report(spark: SparkSession, path: str, expected: list[str]) -> DataFrame:
    """One row for each expected file name: whether it is there, its length and hash."""
    want = spark.createDataFrame([(e,) for e in expected], "name string")
    have = file_hashes(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return want.join(have, "name", "left").select("name", F.col("path").isNotNull().alias("present"), "length", "sha256")


def row_hash(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of some columns."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def key_grid(spark: SparkSession, entities: DataFrame, first: int, last: int) -> DataFrame:
    """(entity, year): every entity in every year from first to last."""
    return entities.select("entity").distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))


def explode_items(df: DataFrame, column: str, item: str) -> DataFrame:
    """One row for each whole number in a list separated by commas, semicolons or blanks."""
    parts = F.explode(F.split(F.coalesce(column, F.lit("")), r"[,;\s]+"))
    return df.withColumn("_p", parts).withColumn(item, F.expr("try_cast(_p AS int)")).where(F.col(item).isNotNull()).drop("_p").distinct()
