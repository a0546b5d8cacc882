"""Baselines and diagnostics that need no more than sums: fixed effects, ridge, residual and spatial dependence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.ordering import edges, quantiles_by


def fixed_effects(panel: DataFrame, entity: str, x: str, y: str, fit: Column) -> DataFrame:
    """panel with `pred` of y = own level + slope * x, fitted within entities; unseen entities get the mean level."""
    seen = panel.where(fit)
    means = seen.groupBy(F.col(entity).alias("_e")).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.count(F.lit(1)).alias("_n"))
    held = seen.join(means, F.col(entity) == F.col("_e"))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    slope = held.agg((F.sum(dx * dy) / F.sum(dx * dx)).alias("_b"))
    levels = means.crossJoin(F.broadcast(slope)).select("_e", "_n", "_b", (F.col("_my") - F.col("_b") * F.col("_mx")).alias("_level"))
    pooled = levels.agg((F.sum(F.col("_level") * F.col("_n")) / F.sum("_n")).alias("_pooled"), F.first("_b").alias("_slope"))
    out = panel.join(levels.drop("_b", "_n"), F.col(entity) == F.col("_e"), "left").crossJoin(F.broadcast(pooled))
    return out.withColumn("pred", F.coalesce("_level", "_pooled") + F.col("_slope") * F.col(x)).drop("_e", "_level", "_pooled", "_slope")


def quadratic_effects(panel: DataFrame, entity: str, x: str, z: str, y: str, fit: Column) -> DataFrame:
    """One row: rows and coefficients of y on x, z and z squared within entities, from one pass of sums over demeaned rows."""
    seen = panel.where(fit).select(entity, *[F.col(c).cast("double").alias(n) for c, n in ((x, "a"), (z, "b"), (y, "y"))]).withColumn("c", F.col("b") * F.col("b"))
    means = seen.groupBy(F.col(entity).alias("_e")).agg(*[F.avg(n).alias(f"_{n}") for n in "abcy"])
    held = seen.join(means, F.col(entity) == F.col("_e")).select(*[(F.col(n) - F.col(f"_{n}")).alias(n) for n in "abcy"])
    sums = held.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in ("aa", "ab", "ac", "bb", "bc", "cc", "ay", "by", "cy")])

    def det(rows: list[list[str]]) -> Column:
        m = [[F.col(c) for c in row] for row in rows]
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    whole = [["aa", "ab", "ac"], ["ab", "bb", "bc"], ["ac", "bc", "cc"]]
    right = ["ay", "by", "cy"]
    with_y = lambda k: [[right[i] if j == k else c for j, c in enumerate(row)] for i, row in enumerate(whole)]
    return sums.select("n", *[F.try_divide(det(with_y(k)), det(whole)).alias(n) for k, n in enumerate(("slope", "linear", "quadratic"))])


def near_duplicate_columns(df: DataFrame, columns: list[str], fit: Column, limit: float = 0.98, least: int = 1000) -> DataFrame:
    """(column, kept, twin): columns in order; one that correlates beyond the limit with a kept one before it is dropped.

    Pairs with fewer than `least` common rows are not judged. All pairs come from one aggregate, a row in all.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.where(fit).agg(*[F.struct(F.corr(a, b).alias("r"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n")).alias(f"{a} {b}") for a, b in pairs]).first()
    twin: dict[str, str] = {}
    for a, b in pairs:
        found = one[f"{a} {b}"]
        if a not in twin and b not in twin and found.n >= least and found.r is not None and abs(found.r) >= limit:
            twin[b] = a
    return df.sparkSession.createDataFrame([(c, c not in twin, twin.get(c)) for c in columns], "`column` string, kept boolean, twin string")


def prune_columns(df: DataFrame, columns: list[str], target: str, fit: Column, limit: float = 0.95, most_vif: float = 10.0, protected: tuple[str, ...] = ()) -> DataFrame:
    """(column, kept, reason): of two columns that correlate beyond the limit the one nearer the target stays; then the
    column of the highest inflation goes until none is above most_vif. Protected columns stay. One aggregate gives all
    correlations, the rest is on a matrix with a row a column.
    """
    import numpy as np

    names = [*columns, target]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = df.where(fit).agg(*[F.corr(a, b).alias(f"{a} {b}") for a, b in pairs]).first()
    r = {frozenset((a, b)): one[f"{a} {b}"] or 0.0 for a, b in pairs}
    near, kept, why = lambda c: abs(r[frozenset((c, target))]), list(columns), {}
    for a, b in sorted(pairs, key=lambda p: -abs(r[frozenset(p)])):
        if target in (a, b) or a not in kept or b not in kept or abs(r[frozenset((a, b))]) <= limit:
            continue
        loose = [c for c in sorted((a, b), key=near) if c not in protected]
        if loose:
            kept.remove(loose[0])
            why[loose[0]] = "correlation"
    while len(kept) > 1:
        m = np.array([[1.0 if a == b else r[frozenset((a, b))] for b in kept] for a in kept])
        vif = dict(zip(kept, np.linalg.pinv(m).diagonal(), strict=True))
        worst = max((c for c in kept if c not in protected), key=lambda c: vif[c], default=None)
        if worst is None or vif[worst] <= most_vif:
            break
        kept.remove(worst)
        why[worst] = "inflation"
    return df.sparkSession.createDataFrame([(c, c in kept, why.get(c, "")) for c in columns], "`column` string, kept boolean, reason string")


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)


def tree_model(kind: str, depth: int = 4, trees: int = 10, y: str = "y", seed: int = 1):
    """An untrained MLlib forest or boosted trees that read the vector column _x."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    if kind == "forest":
        return RandomForestRegressor(featuresCol="_x", labelCol=y, predictionCol="pred", maxDepth=depth, numTrees=trees, seed=seed)
    return GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="pred", maxDepth=depth, maxIter=trees, seed=seed)


def tree_predictions(df: DataFrame, features: list[str], y: str, fit: Column, kind: str = "boosted", **options) -> DataFrame:
    """df with `pred` of trees trained on the rows with `fit`; rows with a null feature are left out."""
    held = _assembled(df, features)
    return tree_model(kind, y=y, **options).fit(held.where(fit)).transform(held).drop("_x")


def tree_intervals(df: DataFrame, features: list[str], y: str, fit: Column, dev: Column, alpha: float = 0.1, bins: int = 5, **options) -> DataFrame:
    """df with pred, lo and hi: bounds are pred plus the alpha / 2 and 1 - alpha / 2 quantiles of dev residuals of like predictions.

    MLlib has no quantile loss; predictions are put in bins by dev quantiles and residuals are taken by bin.
    """
    held = tree_predictions(df, features, y, fit, **options)
    cuts = edges(held.where(dev), "pred", [i / bins for i in range(1, bins)], "_e")
    binned = held.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col("pred")))).drop("_e")
    e = F.col(y) - F.col("pred")
    own = quantiles_by(binned.where(dev).select("_b", e.alias("_r")), ["_b"], "_r", {"_lo": lambda n: F.lit(alpha / 2), "_hi": lambda n: F.lit(1 - alpha / 2)}).drop("n")
    out = binned.join(F.broadcast(own), "_b", "left")
    return out.withColumn("lo", F.col("pred") + F.coalesce("_lo", F.lit(0.0))).withColumn("hi", F.col("pred") + F.coalesce("_hi", F.lit(0.0))).drop("_b", "_lo", "_hi")


def grid_search(df: DataFrame, features: list[str], y: str, fit: Column, dev: Column, grid: list[dict]) -> DataFrame:
    """(options, rmse, best) of each setting of the boosted trees on the dev rows; fitted on the rows with `fit`."""
    held = _assembled(df, features)
    e = F.col(y) - F.col("pred")
    found = [(str(sorted(g.items())), tree_model(g.pop("kind", "boosted"), y=y, **g).fit(held.where(fit)).transform(held.where(dev)).agg(F.sqrt(F.avg(e * e))).first()[0]) for g in [dict(g) for g in grid]]
    least = min(v for _, v in found)
    return df.sparkSession.createDataFrame([(k, float(v), v == least) for k, v in found], "options string, rmse double, best boolean")


def ablation(df: DataFrame, groups: dict[str, list[str]], y: str, fit: Column, test: Column, **options) -> DataFrame:
    """(left_out, rmse, change) of trees without each group of columns against those with all of them."""
    every = [c for columns in groups.values() for c in columns]
    e = F.col(y) - F.col("pred")

    def rmse(columns: list[str]) -> float:
        return float(tree_predictions(df, columns, y, fit, **options).where(test).agg(F.sqrt(F.avg(e * e))).first()[0])

    whole = rmse(every)
    rows = [("none", whole, 0.0)] + [(g, v := rmse([c for c in every if c not in columns]), v - whole) for g, columns in groups.items()]
    return df.sparkSession.createDataFrame(rows, "left_out string, rmse double, change double")


def consensus_selection(df: DataFrame, features: list[str], y: str, fit: Column, share: float = 0.65, votes: int = 2, protected: tuple[str, ...] = (), bins: int = 8) -> DataFrame:
    """(feature, information, forest, boosted, permutation, votes, selected) by four rankings of the features.

    A feature gets a vote from each ranking that has it in its first `share`; `votes` of them select it, as does protection.
    Information is the mutual information of binned values, permutation the loss of accuracy when values are shuffled
    between rows by a hash.
    """
    import math as m

    held = _assembled(df.where(fit).na.drop(subset=[*features, y]), features)
    below = lambda c: F.size(F.filter(f"_e_{c}", lambda e: e < F.col(c)))
    binned = held
    for c in [*features, y]:
        binned = binned.crossJoin(F.broadcast(edges(held, c, [i / bins for i in range(1, bins)], f"_e_{c}")))
    binned = binned.select(*[below(c).alias(c) for c in [*features, y]])

    def information(c: str) -> float:
        cells = binned.groupBy(c, y).agg(F.count(F.lit(1)).alias("n")).collect()  # bins * bins rows at most
        n, a, b = sum(r.n for r in cells), {}, {}
        for r in cells:
            a[r[c]], b[r[y]] = a.get(r[c], 0) + r.n, b.get(r[y], 0) + r.n
        return sum(r.n / n * m.log(r.n * n / (a[r[c]] * b[r[y]])) for r in cells)

    forest, boosted = (tree_model(k, y=y).fit(held) for k in ("forest", "boosted"))
    error = lambda rows: rows.agg(F.avg(F.pow(F.col(y) - F.col("pred"), F.lit(2)))).first()[0]
    base = error(forest.transform(held))
    spread = Window.partitionBy(F.pmod(F.xxhash64(*features, y), F.lit(64))).orderBy(F.xxhash64(F.lit(7), *features, y))

    def permuted(c: str) -> float:
        moved = held.drop("_x").withColumn("_m", F.lead(c, 1).over(spread)).withColumn(c, F.coalesce("_m", c)).drop("_m")
        return error(forest.transform(_assembled(moved, features))) - base

    scores = {"information": [information(c) for c in features], "forest": list(map(float, forest.featureImportances.toArray())), "boosted": list(map(float, boosted.featureImportances.toArray())), "permutation": [permuted(c) for c in features]}
    first = m.ceil(share * len(features))
    won = {c: 0 for c in features}
    for values in scores.values():
        for i in sorted(range(len(features)), key=lambda i: -values[i])[:first]:
            won[features[i]] += 1
    rows = [(c, *[float(scores[k][i]) for k in scores], won[c], won[c] >= votes or c in protected) for i, c in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, information double, forest double, boosted double, permutation double, votes int, selected boolean")


def ridge(panel: DataFrame, features: list[str], y: str, penalty: float, fit: Column) -> DataFrame:
    """panel with `pred` of MLlib's ridge regression on the rows with `fit`."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    held = VectorAssembler(inputCols=features, outputCol="_x").transform(panel)
    model = LinearRegression(featuresCol="_x", labelCol=y, regParam=penalty, predictionCol="pred").fit(held.where(fit))
    return model.transform(held).drop("_x")


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, vif) from the inverse of the correlation matrix, which has one row a column."""
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    held = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(df)
    inverse = np.linalg.pinv(Correlation.corr(held, "_x").first()[0].toArray())
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, inverse.diagonal(), strict=True)], "`column` string, vif double")


def high_correlations(df: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """(left, right, r) of column pairs whose correlation is beyond the limit, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a} {b}") for a, b in pairs])
    long = one.unpivot([], [f"{a} {b}" for a, b in pairs], "pair", "r")
    return long.where(F.abs("r") > limit).select(F.split("pair", " ")[0].alias("left"), F.split("pair", " ")[1].alias("right"), "r")


def serial_dependence(series: DataFrame, order: str, value: str) -> DataFrame:
    """One row: lag-1 autocorrelation and Durbin-Watson statistic of an ordered series of residuals."""
    w = Window.partitionBy(F.lit(1)).orderBy(order)
    held = series.withColumn("_p", F.lag(value).over(w))
    step = F.col(value) - F.col("_p")
    return held.agg(F.corr(value, "_p").alias("lag1"), (F.sum(step * step) / F.sum(F.col(value) * F.col(value))).alias("durbin_watson"))


def morans_i(sites: DataFrame, key: str, x: str, y: str, value: str, most: int = 500) -> DataFrame:
    """One row: Moran's I with inverse-distance weights over all pairs of `most` sites, those with the smallest key hashes.

    The statistic is one of a sample by definition; `most` bounds both the pairs and what is broadcast.
    """
    sites = sites.orderBy(F.xxhash64(key), key).limit(most)
    mean = sites.agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    held = sites.crossJoin(F.broadcast(mean)).select(key, x, y, (F.col(value) - F.col("_m")).alias("z"), "_n")
    a, b = held.alias("a"), held.alias("b")
    d = F.sqrt(F.pow(F.col(f"a.{x}") - F.col(f"b.{x}"), 2) + F.pow(F.col(f"a.{y}") - F.col(f"b.{y}"), 2))
    pairs = a.join(F.broadcast(b), (F.col(f"a.{key}") < F.col(f"b.{key}"))).where(d > 0).agg(F.sum(F.col("a.z") * F.col("b.z") / d).alias("_zz"), F.sum(1 / d).alias("_w"))
    total = held.agg(F.sum(F.col("z") * F.col("z")).alias("_s"), F.first("_n").alias("_n"))
    return pairs.crossJoin(total).select((F.col("_n") * F.col("_zz") / F.col("_w") / F.col("_s")).alias("morans_i"))


def relative_class(days: Column, percentile: Column) -> Column:
    """Risk class from days of stress and their percentile in the entity's own record."""
    return F.when(days == 0, "Low").when(percentile >= 0.9, "Very High").when(percentile >= 0.75, "High").when(percentile >= 0.5, "Moderate").otherwise("Low")


def alerts(level: Column, change: Column) -> Column:
    """Array of (rule, severity) of the rules that hold."""
    rule = lambda c, name, severity: F.when(c, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))
    return F.filter(F.array(rule(level >= 3, "many_days", "high"), rule((level >= 1) & (level < 3), "some_days", "medium"), rule(change <= -10, "large_drop", "high"), rule(change >= 10, "large_rise", "info")), lambda x: x.isNotNull())
