"""Preprocessing fitted on training rows alone: normals, scaling, zero fills, and checks that fail fast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.scalars import probit
from loomspan.operators.ordering import edges


def normals_and_anomalies(panel: DataFrame, entity: str, columns: list[str], fit: Column) -> DataFrame:
    """panel with <c>_normal, the entity's mean over the rows with `fit` (else the overall one), and <c>_anomaly."""
    own = panel.where(fit).groupBy(F.col(entity).alias("_e")).agg(*[F.avg(c).alias(f"_n_{c}") for c in columns])
    every = panel.where(fit).agg(*[F.avg(c).alias(f"_o_{c}") for c in columns])
    held = panel.join(own, F.col(entity) == F.col("_e"), "left").crossJoin(F.broadcast(every))
    held = held.withColumns({f"{c}_normal": F.coalesce(f"_n_{c}", f"_o_{c}") for c in columns})
    held = held.withColumns({f"{c}_anomaly": F.col(c) - F.col(f"{c}_normal") for c in columns})
    return held.drop("_e", *[f"_n_{c}" for c in columns], *[f"_o_{c}" for c in columns])


def robust_scale(df: DataFrame, columns: list[str], fit: Column) -> DataFrame:
    """Columns less their median over interquartile range, both of the rows with `fit`; a range of 0 counts as 1."""
    out = df
    for c in columns:
        out = out.crossJoin(F.broadcast(edges(df.where(fit), c, [0.25, 0.5, 0.75], f"_q_{c}")))
    q = lambda c, k: F.col(f"_q_{c}")[k]
    width = lambda c: F.when(q(c, 2) == q(c, 0), 1.0).otherwise(q(c, 2) - q(c, 0))
    return out.withColumns({c: (F.col(c) - q(c, 1)) / width(c) for c in columns}).drop(*[f"_q_{c}" for c in columns])


def standard_scale(df: DataFrame, columns: list[str], fit: Column) -> DataFrame:
    """Columns less their mean over population standard deviation, both of the rows with `fit`; a deviation of 0 counts as 1."""
    moments = df.where(fit).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    of = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return df.crossJoin(F.broadcast(moments)).withColumns({c: of(c) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def normal_scores(df: DataFrame, column: str, fit: Column, points: int = 100, bound: float = 1e-7) -> DataFrame:
    """df with <column>_z: the normal score of the column's place among `points` + 1 quantiles of the rows with `fit`.

    Places between two quantiles are interpolated; values beyond the ends get the ends' scores.
    """
    places = edges(df.where(fit), column, [i / points for i in range(points + 1)], "_e")
    held = df.crossJoin(F.broadcast(places)).withColumn("_k", F.size(F.filter("_e", lambda e: e <= F.col(column))))
    low, high = F.element_at("_e", F.greatest("_k", F.lit(1))), F.element_at("_e", F.least(F.col("_k") + 1, F.lit(points + 1)))
    share = F.when(F.col("_k") == 0, 0.0).when(F.col("_k") > points, 1.0).otherwise((F.col("_k") - 1 + (F.col(column) - low) / (high - low)) / points)
    p = F.least(F.greatest(share, F.lit(bound)), F.lit(1 - bound))
    return held.withColumn(f"{column}_z", F.when(F.col(column).isNotNull(), probit(p))).drop("_e", "_k")


def structural_zero(value: str, available: Column) -> Column:
    """0 where a null says that nothing happened (the source covers the row), null where the source is missing."""
    return F.when(F.col(value).isNull() & available, 0.0).otherwise(F.col(value))


def incomplete(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(column, bad, first_key): nulls and NaN of each column, and the smallest key that has one."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    at = F.concat_ws("/", *key)
    one = df.agg(*[F.struct(F.count_if(bad(c)).alias("bad"), F.min(F.when(bad(c), at)).alias("first_key")).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "_s").select("column", "_s.bad", "_s.first_key")


def require_complete(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """df itself; raises ValueError naming the first bad row of each column that has nulls or NaN."""
    found = incomplete(df, key, columns).where("bad > 0").collect()  # a row a column
    if found:
        raise ValueError("; ".join(f"{r['column']}: {r.bad} null or NaN, first at {r.first_key}" for r in found))
    return df


def missing_before_after(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing_before, missing_after, filled) around a fill."""
    nulls = lambda df, name: df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot([], columns, "column", name)
    both = nulls(before, "missing_before").join(nulls(after, "missing_after"), "column", "full_outer")
    return both.withColumn("filled", F.col("missing_before") - F.col("missing_after"))
