"""Standardised indices: fits by plain aggregates, distribution functions, and normal scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.scalars import probit
from loomspan.functions.special import lower_gamma
from loomspan.operators.timeseries import near_slots

PI = 3.141592653589793


def glo_fit(series: DataFrame, keys: list[str], value: str, order: str, least: int = 10) -> DataFrame:
    """(keys, n, k, alpha, xi) of generalised logistic distributions by unbiased probability-weighted moments."""
    w = Window.partitionBy(*keys)
    held = series.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value, order))).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
    i, n, v = F.col("_i"), F.col("_n"), F.col(value)
    b = held.groupBy(*keys).agg(
        F.max(n).alias("n"), F.avg(v).alias("b0"), (F.sum((i - 1) * v / (n - 1.0)) / F.max(n)).alias("b1"), (F.sum((i - 1) * (i - 2) * v / ((n - 1.0) * (n - 2.0))) / F.max(n)).alias("b2")
    )
    l2, l3 = 2 * F.col("b1") - F.col("b0"), 6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")
    k = F.try_divide(-l3, l2)
    b = b.select(*keys, "n", F.col("b0").alias("l1"), l2.alias("l2"), k.alias("k"))
    # towards k = 0 the distribution is the logistic one
    flat = F.abs("k") < 1e-6
    k = F.when(~flat, F.col("k"))
    b = b.withColumn("alpha", F.when(flat, F.col("l2")).otherwise(F.col("l2") * F.sin(k * PI) / (k * PI)))
    xi = F.when(flat, F.col("l1")).otherwise(F.col("l1") - F.col("alpha") * (1 / k - PI / F.sin(k * PI)))
    return b.select(*keys, "n", F.when(flat, 0.0).otherwise(F.col("k")).alias("k"), "alpha", xi.alias("xi"))


def glo_cdf(value: str) -> Column:
    """Distribution function at `value` with the columns k, alpha and xi of glo_fit(); 0 or 1 beyond its bound."""
    z = (F.col(value) - F.col("xi")) / F.col("alpha")
    inner = 1 - F.col("k") * z
    beyond = F.when(F.col("k") > 0, 1.0).otherwise(0.0)
    power = F.when(F.col("k") == 0, -z).otherwise(F.ln(F.when(inner > 0, inner)) / F.nullif(F.col("k"), F.lit(0.0)))
    return F.when(F.col(value).isNull(), None).when(inner <= 0, beyond).otherwise(1 / (1 + F.exp(power)))


def gamma_fit(series: DataFrame, keys: list[str], value: str, dry: float = 0.01, least: int = 10) -> DataFrame:
    """(keys, n, zeros, shape, scale) of gamma distributions of the values from `dry` up (Thom's estimate).

    A series of one value has no spread: its shape and scale are null.
    """
    wet = F.when(F.col(value) >= dry, F.col(value))
    a = F.ln(F.avg(wet)) - F.avg(F.ln(wet))
    held = series.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) < dry).alias("zeros"), F.count(wet).alias("_wet"), F.avg(wet).alias("_m"), F.when(a > 1e-12, (1 + F.sqrt(1 + 4 * a / 3)) / (4 * a)).alias("shape")
    )
    return held.where(F.col("_wet") >= least).withColumn("scale", F.col("_m") / F.col("shape")).drop("_wet", "_m")


def gamma_cdf(value: str, dry: float = 0.01) -> Column:
    """Mixed distribution function with the columns of gamma_fit(): half the zero mass at dry values."""
    q = F.col("zeros") / F.col("n")
    return F.when(F.col(value).isNull(), None).when(F.col(value) < dry, q / 2).otherwise(q + (1 - q) * lower_gamma(F.col("shape"), F.col(value) / F.col("scale")))


def standardise(rows: DataFrame, cdf: Column, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """rows with `index`, the normal score of the distribution function held within [low, high]."""
    held = rows.withColumn("_p", F.when(cdf.isNotNull(), F.least(F.greatest(cdf, F.lit(low)), F.lit(high))))
    return held.withColumn("index", probit(F.col("_p"))).drop("_p")


def log_logistic_fit(series: DataFrame, keys: list[str], value: str, order: str, least: int = 10) -> DataFrame:
    """(keys, n, scale, shape, origin) of three-parameter log-logistic distributions by probability-weighted moments.

    The product of gamma functions in it is that of a sine: gamma(1 + x) * gamma(1 - x) = pi * x / sin(pi * x).
    """
    w = Window.partitionBy(*keys)
    held = series.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(F.desc(value), order))).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
    left = (F.col("_n") - F.col("_i")) / (F.col("_n") - 1.0)
    more = left * (F.col("_n") - F.col("_i") - 1) / (F.col("_n") - 2.0)
    v = F.col(value)
    rising = held.groupBy(*keys).agg(F.max("_n").alias("n"), F.avg(v).alias("b0"), F.avg(left * v).alias("b1"), F.avg(more * v).alias("b2"))
    shape = F.try_divide(2 * F.col("b1") - F.col("b0"), 6 * F.col("b1") - F.col("b0") - 6 * F.col("b2"))
    out = rising.withColumn("shape", shape)
    x = 1 / F.nullif(F.col("shape"), F.lit(0.0))
    both = PI * x / F.nullif(F.sin(PI * x), F.lit(0.0))
    out = out.withColumn("scale", (F.col("b0") - 2 * F.col("b1")) * F.col("shape") / both).withColumn("origin", F.col("b0") - F.col("scale") * both)
    return out.select(*keys, "n", "scale", "shape", "origin")


def slot_fit(series: DataFrame, keys: list[str], slot: str, reach: int, calibration: Column, fit) -> DataFrame:
    """fit(rows, keys + slot) over the calibration rows within `reach` slots of each slot."""
    near = near_slots(series.where(calibration), slot, reach).drop(slot).withColumnRenamed("near", slot)
    return fit(near, [*keys, slot])


def calibration_check(rows: DataFrame, index: str, *keys: str) -> DataFrame:
    """(keys, n, mean, sd, below, missing): how close an index comes to a standard normal variable; below is the share under -1."""
    z = F.col(index)
    return rows.groupBy(*keys).agg(F.count(z).alias("n"), F.avg(z).alias("mean"), F.stddev_samp(z).alias("sd"), F.avg(F.when(z.isNotNull(), (z < -1).cast("int"))).alias("below"), F.count_if(z.isNull()).alias("missing"))
