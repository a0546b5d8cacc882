"""Coverage-gated, weighted and profiling aggregates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.ordering import quantiles_by


def gated(agg: Column, valid: Column, wanted: Column, share: float) -> Column:
    """An aggregate, if at least `share` of the wanted rows are valid."""
    return F.when(F.coalesce(valid / F.nullif(wanted, F.lit(0)), F.lit(1.0)) >= share, agg)


def window_block(value: str, inside: Column, prefix: str, mean_share: float = 0.95, total_share: float = 1.0) -> list[Column]:
    """Days, valid days, mean, smallest and largest (gated at mean_share) and total (at total_share) of the rows inside a window.

    An empty window has total 0 and no mean.
    """
    x = F.when(inside, F.col(value))
    n, valid = F.count_if(inside), F.count(x)
    return [
        n.alias(f"{prefix}_days"),
        valid.alias(f"{prefix}_valid"),
        gated(F.avg(x), valid, n, mean_share).alias(f"{prefix}_mean"),
        gated(F.min(x), valid, n, mean_share).alias(f"{prefix}_min"),
        gated(F.max(x), valid, n, mean_share).alias(f"{prefix}_max"),
        gated(F.coalesce(F.sum(x), F.lit(0.0)), valid, n, total_share).alias(f"{prefix}_total"),
    ]


class Feature(NamedTuple):
    """A daily value, and what is made of it in each window: mean, min, max, total, valid (days with a value), count (days with `when`)."""

    name: str
    value: Column
    stats: tuple[str, ...]
    when: Column | None = None


def feature_block(rows: DataFrame, keys: list[str], windows: dict[str, Column], features: list[Feature], mean_share: float = 0.95, total_share: float = 1.0) -> DataFrame:
    """One row a key: days_<window>, and <feature>_<stat>_<window> of every feature in every window, all in one grouped pass.

    mean, min and max are null where less than mean_share of the window's days have a value, total and count where less than
    total_share have. A window without days has totals and counts of 0 and no mean. Windows may overlap; a null in a
    window's condition leaves the day out of it. Counts that several features share are taken once by Spark.
    """
    out = []
    for w, condition in windows.items():
        inside = F.coalesce(condition, F.lit(False))
        n = F.count_if(inside)
        out.append(n.alias(f"days_{w}"))
        for f in features:
            x = F.when(inside, f.value)
            valid = F.count(x)
            made = {
                "mean": lambda: gated(F.avg(x), valid, n, mean_share), "min": lambda: gated(F.min(x), valid, n, mean_share), "max": lambda: gated(F.max(x), valid, n, mean_share), "valid": lambda: valid,
                "total": lambda: gated(F.coalesce(F.sum(x), F.lit(0.0)), valid, n, total_share), "count": lambda: gated(F.count_if(x.isNotNull() & f.when), valid, n, total_share),
            }
            out += [made[stat]().alias(f"{f.name}_{stat}_{w}") for stat in f.stats]
    return rows.groupBy(*keys).agg(*out)


def weighted_mean(x: str, w: str) -> Column:
    """Mean of x by w over rows where both are there and w is not 0."""
    ok = F.col(x).isNotNull() & F.col(w).isNotNull() & (F.col(w) != 0)
    return F.try_divide(F.sum(F.when(ok, F.col(x) * F.col(w))), F.sum(F.when(ok, F.col(w))))


def weighted_variance(mean: str, variance: str, w: str) -> Column:
    """Variance of a whole whose weighted parts have means and variances: within plus between."""
    whole = F.sum(w)
    return F.sum(F.col(w) * (F.col(variance) + F.col(mean) * F.col(mean))) / whole - F.pow(F.sum(F.col(w) * F.col(mean)) / whole, 2)


def skewness(x: str) -> Column:
    """Sample skewness with the usual bias correction."""
    n = F.count(x)
    return F.skewness(x) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2, F.lit(0))


def kurtosis(x: str) -> Column:
    """Sample excess kurtosis with the usual bias correction."""
    n = F.count(x)
    return (n - 1.0) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(x) + 6)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, mean, std, min, max, skewness, kurtosis and percent outside 1.5 interquartile ranges."""
    long = unpivot(df, columns)
    edges = quantiles_by(long, ["column"], "value", {"q1": lambda n: F.lit(0.25), "q3": lambda n: F.lit(0.75)}).drop("n")
    held = long.join(F.broadcast(edges), "column")  # one row a column
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    outside = (F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)
    return held.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        skewness("value").alias("skew"), kurtosis("value").alias("kurt"), (100.0 * F.count_if(outside) / F.count("value")).alias("iqr_outlier_pct"),
    )


def unpivot(df: DataFrame, columns: list[str], *ids: str) -> DataFrame:
    """(ids, column, value) with values as doubles."""
    return df.unpivot(list(ids), [F.col(c).cast("double").alias(c) for c in columns], "column", "value")


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: rows, missing ones and their percentage."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot(["_n"], columns, "column", "missing")
    return long.select("column", F.col("_n").alias("n"), "missing", (100.0 * F.col("missing") / F.col("_n")).alias("missing_pct"))


def static_columns(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """(keys, <c>_first, <c>_last): the first and last value of each column by itself in the order, nulls passed over."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    return rows.groupBy(*keys).agg(*[f(c, at(c)).alias(f"{c}_{name}") for c in columns for f, name in ((F.min_by, "first"), (F.max_by, "last"))])
