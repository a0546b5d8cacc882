"""Splits by hash, and lags and rolling means that look only at the parts a row may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.inference import draw

#: Parts that a part's rows may take earlier values from.
OWN_AND_TRAIN = {"TRAIN": ("TRAIN",), "VAL": ("TRAIN", "VAL"), "TEST": ("TRAIN", "TEST")}
OWN = {"TRAIN": ("TRAIN",), "VAL": ("VAL",), "TEST": ("TEST",)}
ALL = {"TRAIN": ("TRAIN", "VAL", "TEST"), "VAL": ("TRAIN", "VAL", "TEST"), "TEST": ("TRAIN", "VAL", "TEST")}


def random_part(key: Column, other: Column, seed: int = 42, train: float = 0.7, val: float = 0.1) -> Column:
    """TRAIN, VAL or TEST by a hash of the key: no shuffle, the same for every run, shares met up to chance.

    With the entity alone as key (other = 0) all rows of an entity fall into one part.
    """
    u = draw(F.lit(seed), key, other, F.lit(1_000_000))
    return F.when(u < int(train * 1_000_000), "TRAIN").when(u < int((train + val) * 1_000_000), "VAL").otherwise("TEST")


def _may_see(part: str, source: str, scopes: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(False)
    for own, seen in scopes.items():
        out = out | (F.col(part) == own) & F.col(source).isin(*seen)
    return out


def scoped_lag(panel: DataFrame, k: int, entity: str, order: str, value: str, part: str, scopes: dict[str, tuple[str, ...]]) -> DataFrame:
    """panel with lag_k from the entity's row exactly k before, null where that row's part may not be seen."""
    return scoped_lags(panel, k, entity, order, value, {"_mode": (part, scopes)}).withColumnRenamed("lag__mode", f"lag_{k}")


def scoped_lags(panel: DataFrame, k: int, entity: str, order: str, value: str, modes: dict[str, tuple[str, dict[str, tuple[str, ...]]]]) -> DataFrame:
    """panel with lag_<mode> for each mode (a column of parts, and what they may see), as scoped_lag() gives it.

    All modes read one join, so rows are made, sorted and joined once however many modes there are.
    """
    source = panel.select(F.col(entity).alias("_e"), (F.col(order) + k).alias("_o"), F.col(value).alias("_v"), *[F.col(part).alias(f"_p_{m}") for m, (part, _) in modes.items()])
    held = panel.join(source, (F.col(entity) == F.col("_e")) & (F.col(order) == F.col("_o")), "left")
    lags = {f"lag_{m}": F.when(_may_see(part, f"_p_{m}", scopes), F.col("_v")) for m, (part, scopes) in modes.items()}
    return held.withColumns(lags).drop("_e", "_o", "_v", *[f"_p_{m}" for m in modes])


def scoped_rolling(panel: DataFrame, rows: int, entity: str, order: str, value: str, part: str, scopes: dict[str, tuple[str, ...]]) -> DataFrame:
    """panel with roll_n, the mean of the last n rows (this one included) among those that the row's part may see.

    A row stands once in every scope that holds its part, so one window serves all scopes.
    """
    readers = F.array(*[F.when(F.col(part).isin(*seen), F.lit(own)) for own, seen in scopes.items()])
    spread = panel.withColumn("_scope", F.explode(F.filter(readers, lambda x: x.isNotNull())))
    w = Window.partitionBy("_scope", entity).orderBy(order).rowsBetween(1 - rows, 0)
    return spread.withColumn(f"roll_{rows}", F.avg(value).over(w)).where(F.col("_scope") == F.col(part)).drop("_scope")


def split_audit(panel: DataFrame, key: str, year: str, part: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(left_part, right_part, shared, in_order, verdict) for pairs of parts: shared keys, and whether all years of the left one come first.

    Keys are reduced to their sets of parts, and parts to their first and last years, in one pass each.
    """
    per_key = panel.groupBy(key).agg(F.collect_set(part).alias("_parts"))
    shared = per_key.agg(*[F.count_if(F.array_contains("_parts", a) & F.array_contains("_parts", b)).alias(f"{a} {b}") for a, b in pairs])
    long = shared.unpivot([], [f"{a} {b}" for a, b in pairs], "_pair", "shared").select(F.split("_pair", " ")[0].alias("left_part"), F.split("_pair", " ")[1].alias("right_part"), "shared")
    years = panel.groupBy(F.col(part).alias("_part")).agg(F.min(year).alias("_first"), F.max(year).alias("_last"))
    ends = long.join(years.select(F.col("_part").alias("left_part"), "_last"), "left_part", "left").join(years.select(F.col("_part").alias("right_part"), "_first"), "right_part", "left")
    ends = ends.withColumn("in_order", F.coalesce(F.col("_last") < F.col("_first"), F.lit(True)))
    return ends.select("left_part", "right_part", "shared", "in_order", F.when((F.col("shared") == 0) & F.col("in_order"), "PASS").otherwise("FAIL").alias("verdict"))


def lag_leakage(panel: DataFrame, entity: str, order: str, value: str, lag: str, k: int, part: str) -> DataFrame:
    """(part, rows, wrong_value, from_later_part): lags that differ from the value k before, and lags taken across parts."""
    source = panel.select(F.col(entity).alias("_e"), (F.col(order) + k).alias("_o"), F.col(value).alias("_v"), F.col(part).alias("_p"))
    held = panel.join(source, (F.col(entity) == F.col("_e")) & (F.col(order) == F.col("_o")), "left")
    has = F.col(lag).isNotNull()
    return held.groupBy(part).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(has & ~F.col(lag).eqNullSafe(F.col("_v"))).alias("wrong_value"), F.count_if(has & (F.col("_p") != F.col(part)) & (F.col("_p") != "TRAIN")).alias("from_other_part")
    )
