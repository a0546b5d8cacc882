"""Operators over (entity, time, value) series: calendars, strict windows, lags, ranks and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of the widest window that is added up row by row.
NARROW = 31


def daily(df: DataFrame, entity: str, ts: str, value: str, agg=F.sum) -> DataFrame:
    """(entity, day, value): one row for each entity and day that has any row."""
    return df.groupBy(F.col(entity).alias("entity"), F.to_date(ts).alias("day")).agg(agg(value).alias("value"))


def densify(series: DataFrame, entities: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Every entity on every day from first to last; value is null on days without a row.

    A bound that is not given is the series' own first or last day.
    """
    ends = series.agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    bound = lambda given, own: F.col(own) if given is None else F.lit(given).cast("date")
    days = F.explode(F.sequence(bound(first, "_first"), bound(last, "_last"))).alias("day")
    held = entities.select("entity").distinct()
    held = held if first is not None and last is not None else held.crossJoin(F.broadcast(ends)).where("_first IS NOT NULL")
    return held.select("entity", days).join(series, ["entity", "day"], "left")


def strict_rolling_sum(dense: DataFrame, width: int, value: str = "value", out: str = "rolled") -> DataFrame:
    """Sum of the last `width` rows of a dense series, null unless all are there and none is null.

    Windows of up to NARROW rows are added up as they are, so that a sum on a threshold is not off in its last bits. Wider
    ones are the difference of two running sums, so their cost does not grow with the width. NaN and infinite values count
    as missing.
    """
    x = F.col(value).cast("double")
    value = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.col(value))
    w = Window.partitionBy("entity").orderBy("day")
    if width <= NARROW:
        frame = w.rowsBetween(1 - width, 0)
        return dense.withColumn(out, F.when(F.count(value).over(frame) == width, F.sum(value).over(frame)))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    held = dense.withColumn("_s", F.coalesce(F.sum(value).over(running), F.lit(0.0))).withColumn("_n", F.count(value).over(running))
    full = (F.row_number().over(w) >= width) & (F.col("_n") - F.coalesce(F.lag("_n", width).over(w), F.lit(0)) == width)
    return held.withColumn(out, F.when(full, F.col("_s") - F.coalesce(F.lag("_s", width).over(w), F.lit(0.0)))).drop("_s", "_n")


def episodes(flagged: DataFrame, flag: str = "flag", severity: str = "severity") -> DataFrame:
    """One row for each maximal run of consecutive flagged rows: (entity, episode, start, days, severity)."""
    w = Window.partitionBy("entity").orderBy("day")
    on = F.coalesce(F.col(flag), F.lit(False))
    start = on & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    held = flagged.withColumn("episode", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(on)
    return held.groupBy("entity", "episode").agg(F.min("day").alias("start"), F.count(F.lit(1)).alias("days"), F.max(severity).alias("severity"))


def rolling_mean(panel: DataFrame, rows: int, key: str, order: str, value: str) -> Column:
    """Mean of the last `rows` rows that have a value; rows count, not calendar steps."""
    return F.avg(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0))


def exact_lag(k: int, key: str, order: str, value: str) -> Column:
    """Value k steps of `order` before, only if the row k before is exactly that far away."""
    w = Window.partitionBy(key).orderBy(order)
    return F.when(F.lag(order, k).over(w) == F.col(order) - k, F.lag(value, k).over(w))


def partition_lag(panel: DataFrame, k: int, key: str, order: str, value: str, allowed: Column) -> DataFrame:
    """panel with lag_k taken from the row exactly k before, if that row satisfies `allowed` (a fold's training rows)."""
    source = panel.where(allowed).select(F.col(key).alias("_k"), (F.col(order) + k).alias("_o"), F.col(value).alias(f"lag_{k}"))
    return panel.join(source, (F.col(key) == F.col("_k")) & (F.col(order) == F.col("_o")), "left").drop("_k", "_o")


def prior_average(rows: int, least: int, key: str, order: str, value: str) -> Column:
    """Mean of up to `rows` rows before this one, if at least `least` of them have a value."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-rows, -1)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def average_rank(value: str, *keys: str) -> Column:
    """Rank of non-null values from 1 within keys; ties share the mean of their ranks; null for null."""
    order = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def percent_rank(value: str, *keys: str) -> Column:
    """average_rank() over the number of non-null values."""
    return average_rank(value, *keys) / F.count(value).over(Window.partitionBy(*keys))


def equal_count_bin(row: Column, n: Column, bins: int) -> Column:
    """Bin 1..bins of the row-th of n rows by quantile edges of the row number, closed on the right."""
    return F.greatest(F.lit(1), F.ceil(F.lit(bins) * (row - 1) / F.nullif(n - 1, F.lit(0)))).cast("int")


def day_slot(day: Column) -> Column:
    """Day of the year from 1 to 365: 29 February shares 28 February's slot."""
    leap = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31))) == 366
    return F.when(leap & (F.dayofyear(day) >= 60), F.dayofyear(day) - 1).otherwise(F.dayofyear(day))


def near_slots(df: DataFrame, slot: str, reach: int, slots: int = 365) -> DataFrame:
    """Each row once for every slot within reach of its own, around the year's end: a range join as an equi-join."""
    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_o")
    return df.select("*", offsets).withColumn("near", F.pmod(F.col(slot) - 1 + F.col("_o"), F.lit(slots)) + 1).drop("_o")


def interpolate(dense: DataFrame, limit: int, value: str = "value") -> DataFrame:
    """dense with `filled`: gaps of at most `limit` rows between two values are bridged linearly."""
    w = Window.partitionBy("entity").orderBy("day")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    held = dense.withColumn("_i", F.row_number().over(w)).withColumn("_j", F.when(F.col(value).isNotNull(), F.col("_i")))
    for name, frame, pick in (("a", back, F.last), ("b", ahead, F.first)):
        held = held.withColumn(f"_{name}", pick(value, ignorenulls=True).over(frame)).withColumn(f"_{name}i", pick("_j", ignorenulls=True).over(frame))
    bridge = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_i") - F.col("_ai")) / (F.col("_bi") - F.col("_ai"))
    filled = F.coalesce(value, F.when(F.col("_bi") - F.col("_ai") - 1 <= limit, bridge))
    return held.withColumn("filled", filled).drop("_i", "_j", "_a", "_b", "_ai", "_bi")


def de_accumulate(value: str, key: str, order: str) -> Column:
    """Steps of a cumulative series, never below 0; the first step is the first value."""
    w = Window.partitionBy(key).orderBy(order)
    return F.greatest(F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0)), F.lit(0.0))


def hourly_to_daily(hourly: DataFrame, cell: str, hour: str, value: str, least: int = 24) -> DataFrame:
    """(cell, day, mean, low, high, total) of days with at least `least` hours; NaN counts as missing, days without a value are null."""
    v = F.when(~F.isnan(value), F.col(value))
    out = hourly.groupBy(cell, F.to_date(hour).alias("day")).agg(F.count(F.lit(1)).alias("_n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("total"))
    return out.where(F.col("_n") >= least).drop("_n")


def fill_gaps(dense: DataFrame, neighbours: DataFrame, slot: Column) -> DataFrame:
    """(entity, day, filled, how): null values become the mean of neighbours on that day weighted by 1 / distance squared.

    Where no neighbour has a value the entity's own mean of the slot serves. neighbours holds (entity, neighbour, distance).
    """
    holes = dense.where(F.col("value").isNull()).select("entity", "day").join(neighbours, "entity")
    there = dense.where(F.col("value").isNotNull()).select(F.col("entity").alias("neighbour"), "day", F.col("value").alias("_v"))
    weight = 1 / F.pow(F.col("distance"), F.lit(2))
    near = holes.join(there, ["neighbour", "day"]).groupBy("entity", "day").agg((F.sum(F.col("_v") * weight) / F.sum(weight)).alias("_idw"))
    means = dense.groupBy("entity", slot.alias("_slot")).agg(F.avg("value").alias("_mean"))
    held = dense.withColumn("_slot", slot).join(near, ["entity", "day"], "left").join(means, ["entity", "_slot"], "left")
    how = F.when(F.col("value").isNotNull(), "own").when(F.col("_idw").isNotNull(), "neighbours").when(F.col("_mean").isNotNull(), "climatology").otherwise("none")
    return held.select("entity", "day", F.coalesce("value", "_idw", "_mean").alias("filled"), how.alias("how"))
