"""Point and interval metrics, splits, baselines and conformal calibration over prediction rows (y, pred, lo, hi)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.operators.ordering import quantiles, quantiles_by, quantiles_with_pool, running_sums


def interval_metrics(alpha: float = 0.1) -> list[Column]:
    """Coverage, width, Winkler score and the cost of misses below (unsafe) and above; `ace` is signed, `abs_ace` is not."""
    y, lo, hi = F.col("y"), F.col("lo"), F.col("hi")
    below, above = y < lo, y > hi
    miss = F.when(below, lo - y).when(above, y - hi).otherwise(0.0)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return [
        F.count(F.lit(1)).alias("n"),
        share(~below & ~above).alias("picp"),
        (share(~below & ~above) - (1 - alpha)).alias("ace"),
        F.abs(share(~below & ~above) - (1 - alpha)).alias("abs_ace"),
        F.avg(hi - lo).alias("mpiw"),
        F.avg(hi - lo + F.lit(2 / alpha) * miss).alias("winkler"),
        share(below).alias("unsafe_miss_rate"),
        F.count_if(below).alias("n_unsafe"),
        F.avg(F.when(below, lo - y)).alias("mean_shortfall"),
        F.max(F.when(below, lo - y)).alias("worst_shortfall"),
        F.avg(F.when(below, lo - y).otherwise(0.0)).alias("expected_shortfall"),
        share(above).alias("over_rate"),
    ]


def point_metrics() -> list[Column]:
    """RMSE, MAE, R2 (0 for a constant y) and bias as y - pred."""
    e = F.col("y") - F.col("pred")
    total = F.var_pop("y") * F.count("y")
    return [
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(total == 0, 0.0).otherwise(1 - F.sum(e * e) / F.nullif(total, F.lit(0.0))).alias("r2"), F.avg(e).alias("bias"),
    ]


def metrics_with_all(rows: DataFrame, keys: list[str], stratum: str, metrics: list[Column]) -> DataFrame:
    """Metrics by keys and stratum, and by keys alone with the stratum ALL, in one pass."""
    sets = [[F.col(k) for k in keys], [F.col(k) for k in (*keys, stratum)]]
    grouped = rows.groupingSets(sets, *[F.col(k) for k in (*keys, stratum)])
    out = grouped.agg(F.grouping(stratum).alias("_all"), *metrics)
    return out.withColumn(stratum, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(stratum))).drop("_all")


def level(alpha: float, n: Column) -> Column:
    """The quantile level of split conformal prediction for n scores."""
    return F.least(F.ceil(F.lit(1 - alpha) * (n + 1)) / n, F.lit(1.0))


def quantile_at(scores: DataFrame, keys: list[str], score: str, q) -> DataFrame:
    """(keys, n, q): the linearly interpolated quantile of each group's scores at level q(n), which may differ by group.

    The scores are ranked over range partitions, so that no task sorts all of them.
    """
    if not keys:
        return quantiles(scores, score, {"q": q(F.col("n"))})
    return quantiles_by(scores, keys, score, q)


def conformal_static(cal: DataFrame, test: DataFrame, alpha: float = 0.1, score: Column | None = None) -> DataFrame:
    """test with lo and hi widened by the calibration quantile of max(lo - y, y - hi)."""
    score = F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")) if score is None else score
    q = quantile_at(cal.select(score.alias("s")), [], "s", lambda n: level(alpha, n)).select(F.col("q").alias("_q"))
    return test.crossJoin(F.broadcast(q)).withColumn("lo", F.col("lo") - F.col("_q")).withColumn("hi", F.col("hi") + F.col("_q")).drop("_q")


def conformal_by_group(cal: DataFrame, test: DataFrame, group: str, alpha: float = 0.1, least: int = 20) -> DataFrame:
    """As conformal_static() with a quantile for each group; groups with fewer than `least` scores use the pooled one."""
    score = F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")).alias("s")
    own, pooled = quantiles_with_pool(cal.select(F.col(group).alias("_g"), score), "_g", "s", lambda n: level(alpha, n))
    own = own.where(F.col("n") >= least).select("_g", F.col("q").alias("_own"))
    pooled = pooled.select(F.col("q").alias("_pooled"))
    held = test.join(own, F.col(group) == F.col("_g"), "left").crossJoin(F.broadcast(pooled)).withColumn("_q", F.coalesce("_own", "_pooled"))
    return held.withColumn("lo", F.col("lo") - F.col("_q")).withColumn("hi", F.col("hi") + F.col("_q")).drop("_g", "_own", "_pooled", "_q")


def conformal_adaptive_width(cal: DataFrame, test: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Scores are taken relative to the interval's width, so wide intervals widen more."""
    score = F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    q = quantile_at(cal.select(score.alias("s")), [], "s", lambda n: level(alpha, n)).select(F.col("q").alias("_q"))
    held = test.crossJoin(F.broadcast(q)).withColumn("_w", (F.col("hi") - F.col("lo")) * F.col("_q"))
    return held.withColumn("lo", F.col("lo") - F.col("_w")).withColumn("hi", F.col("hi") + F.col("_w")).drop("_q", "_w")


def conformal_asymmetric(cal: DataFrame, test: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Each bound moves by its own quantile at alpha / 2."""
    low = quantile_at(cal.select((F.col("lo") - F.col("y")).alias("s")), [], "s", lambda n: level(alpha / 2, n)).select(F.col("q").alias("_a"))
    high = quantile_at(cal.select((F.col("y") - F.col("hi")).alias("s")), [], "s", lambda n: level(alpha / 2, n)).select(F.col("q").alias("_b"))
    held = test.crossJoin(F.broadcast(low)).crossJoin(F.broadcast(high))
    return held.withColumn("lo", F.col("lo") - F.col("_a")).withColumn("hi", F.col("hi") + F.col("_b")).drop("_a", "_b")


def weighted_quantile(scores: DataFrame, score: str, weight: str, alpha: float = 0.1, *ties: str) -> DataFrame:
    """(q): the first score at which the running share of weight reaches 1 - alpha.

    Scores are summed by value first; the running share is over distinct values, added up over range partitions.
    """
    by_value = scores.groupBy(F.col(score).alias("s")).agg(F.sum(weight).alias("w"))
    total = by_value.agg(F.sum("w").alias("_t"))
    run = running_sums(by_value, "s", "w")
    return run.crossJoin(F.broadcast(total)).where(F.col("up_to_w") >= (1 - alpha) * F.col("_t") - 1e-9).agg(F.min("s").alias("q"))


def conformal_shifted(cal: DataFrame, test: DataFrame, features: list[str], alpha: float = 0.1, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """test with lo and hi widened by the calibration scores' quantile under the test rows' distribution of features.

    A logistic regression tells test rows from calibration rows; its odds, of probabilities held within [low, high],
    weight the scores. As in scikit-learn, half the squared coefficients are added to the summed loss. Rows with a
    null score are left out, as are rows with a null feature from the regression and the weights. Bounds that cross
    meet in their middle.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    score = F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi"))
    own = cal.where(score.isNotNull()).select(*features, score.alias("_s"), F.lit(0.0).alias("_test"))
    both = own.unionByName(test.select(*features, F.lit(None).cast("double").alias("_s"), F.lit(1.0).alias("_test"))).na.drop(subset=features)
    both = scratch.materialize(both, "shifted")  # the fit goes over it many times
    held = VectorAssembler(inputCols=features, outputCol="_x").transform(both)
    fit = LogisticRegression(featuresCol="_x", labelCol="_test", maxIter=500, tol=1e-9, regParam=1 / max(both.count(), 1), standardization=False).fit(held)
    # the model is three numbers or so: rows are scored by columns, and no model travels with the tasks
    margin = F.lit(float(fit.intercept))
    for c, weight in zip(features, fit.coefficients.toArray(), strict=True):
        margin = margin + F.col(c) * float(weight)
    p = F.least(F.greatest(1 / (1 + F.exp(-margin)), F.lit(low)), F.lit(high))
    weighted = both.where("_test = 0").select("_s", (p / (1 - p)).alias("_w"))
    q = weighted_quantile(weighted, "_s", "_w", alpha).select(F.col("q").alias("_q"))
    out = test.crossJoin(F.broadcast(q)).withColumn("lo", F.col("lo") - F.col("_q")).withColumn("hi", F.col("hi") + F.col("_q")).drop("_q")
    middle = (F.col("lo") + F.col("hi")) / 2
    return out.withColumns({c: F.when(F.col("lo") > F.col("hi"), middle).otherwise(F.col(c)) for c in ("lo", "hi")})


def adaptive_conformal(rows: DataFrame, series: str, step: str, alpha: float = 0.1, rate: float = 0.05, low: float = 0.01, high: float = 0.4) -> DataFrame:
    """Adaptive conformal inference, step by step for each series: (series, step, alpha_t, q, n, coverage).

    A step's intervals are widened by the quantile of all earlier scores at the current alpha; then alpha moves by
    rate * (alpha - miss rate) and stays within [low, high]. The first step has no earlier scores: q is 0. Steps are few
    (years): they are a loop, each taking quantiles by ranges; only a row a series comes back. Series are few as well.
    """
    score = F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi"))
    scores = rows.select(F.col(series).alias("_k"), F.col(step).alias("_t"), score.alias("_score"), F.lit(0.0).alias("_x"))
    return _adaptive(scores, series, step, alpha, lambda t: rate, low, high, lambda severity: None).drop("window")


def severity_adaptive_conformal(rows: DataFrame, series: str, step: str, severity: str, alpha: float = 0.1, rate: float = 0.05, widen: float = 0.05, low: float = 0.01, high: float = 0.4) -> DataFrame:
    """Severity-aware adaptive conformal inference: (series, step, alpha_t, q, n, coverage, window).

    Scores are taken relative to 1 + widen * ln(1 + severity), and a row's interval widens by as much. A step looks back
    2 steps if its mean severity is 5 or more, 3 from 1 on, else 5. The rate falls with the root of the step's number.
    """
    weight = 1 + F.lit(widen) * F.ln(1 + F.greatest(F.col(severity), F.lit(0.0)))
    score = F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")) / weight
    scores = rows.select(F.col(series).alias("_k"), F.col(step).alias("_t"), score.alias("_score"), F.col(severity).cast("double").alias("_x"))
    return _adaptive(scores, series, step, alpha, lambda t: rate / math.sqrt(t), low, high, lambda x: 2 if x >= 5 else 3 if x >= 1 else 5)


def _adaptive(scores: DataFrame, series: str, step: str, alpha: float, rate, low: float, high: float, window) -> DataFrame:
    """The loop over steps for scores (_k series, _t step, _score, _x severity).

    Scores are counted by series, step and value once, put in ranges of series and value, and written. The counts of each
    series, step and range tell in which range a step's quantile lies; a step then reads that range, and its own rows.
    """
    spark = scores.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in scores.schema.fields}
    counts = scores.groupBy("_k", "_t", F.col("_score").alias("_s")).agg(F.count(F.lit(1)).alias("_c"), F.sum("_x").alias("_x"), F.count("_x").alias("_cx"))
    held = scratch.materialize(counts.repartitionByRange("_k", "_s").withColumn("_p", F.spark_partition_id()), "adaptive-scores")
    # a row a series, step and range
    cells = held.groupBy("_k", "_t", "_p").agg(F.sum(F.when(F.col("_s").isNotNull(), F.col("_c")).otherwise(0)).alias("n"), F.sum("_x").alias("x"), F.sum("_cx").alias("cx")).collect()
    order, in_range, severity = {}, {}, {}
    for r in cells:
        order.setdefault(r["_k"], set()).add(r["_t"])
        in_range.setdefault(r["_k"], {}).setdefault(r["_p"], {})[r["_t"]] = r["n"]
        x, n = severity.get((r["_k"], r["_t"]), (0.0, 0))
        severity[r["_k"], r["_t"]] = (x + (r["x"] or 0.0), n + r["cx"])
    order = {k: sorted(v) for k, v in order.items()}
    mean = {k: x / n if n else None for k, (x, n) in severity.items()}
    alphas, out = {k: alpha for k in order}, []

    def place(k, first, now, rank: int) -> tuple[int | None, int]:
        """The range that holds the score of a rank (from 0) among a series' earlier ones, and the rank in it."""
        for p in sorted(in_range[k]):
            n = sum(c for t, c in in_range[k][p].items() if first <= t < now)
            if rank < n:
                return p, rank
            rank -= n
        return None, 0

    names = f"_k {kind['_k']}, _now {kind['_t']}, _first {kind['_t']}, _lp int, _lr bigint, _hp int, _hr bigint, _part double"
    for t in range(max(map(len, order.values()), default=0)):
        rows, now = [], {}
        for k, steps in order.items():
            if t < len(steps):
                at = now[k] = steps[t]
                back = window(mean[k, at])
                first = steps[max(0, t - back)] if back else steps[0]
                n = sum(c for p in in_range[k].values() for s, c in p.items() if first <= s < at)
                h = (n - 1) * min(math.ceil((1 - alphas[k]) * (n + 1)) / n, 1.0) if n else 0.0
                low_at, high_at = place(k, first, at, math.floor(h)), place(k, first, at, min(math.floor(h) + 1, max(n - 1, 0)))
                rows.append((k, at, first, *low_at, *high_at, h - math.floor(h)))
        state = spark.createDataFrame(rows, names)
        ranges = [p for r in rows for p in (r[3], r[5]) if p is not None]
        pool = held.where(F.col("_p").isin(ranges)).join(F.broadcast(state), "_k").where((F.col("_t") < F.col("_now")) & (F.col("_t") >= F.col("_first")) & F.col("_s").isNotNull())
        values = pool.groupBy("_k", "_p", "_s").agg(F.sum("_c").alias("_c"), *[F.first(c).alias(c) for c in ("_lp", "_lr", "_hp", "_hr")])
        up_to = F.sum("_c").over(Window.partitionBy("_k", "_p").orderBy("_s"))
        end = lambda p, rank: F.min(F.when((F.col("_p") == F.col(p)) & (F.col("_u") > F.col(rank)), F.col("_s")))
        ends = values.withColumn("_u", up_to).groupBy("_k").agg(end("_lp", "_lr").alias("_a"), end("_hp", "_hr").alias("_b"))
        q = state.join(F.broadcast(ends), "_k", "left").select("_k", F.col("_now").alias("_t"), F.coalesce(F.col("_a") * (1 - F.col("_part")) + F.col("_b") * F.col("_part"), F.lit(0.0)).alias("q"))
        met = held.where(F.col("_t").isin(list(now.values()))).join(F.broadcast(q), ["_k", "_t"])
        inside = F.sum(F.when(F.col("_s") <= F.col("q"), F.col("_c")).otherwise(0)) / F.sum(F.when(F.col("_s").isNotNull(), F.col("_c")))
        for r in met.groupBy("_k").agg(F.first("q").alias("q"), F.sum("_c").alias("n"), inside.alias("c")).collect():  # a row a series
            k = r["_k"]
            out.append((k, now[k], alphas[k], r.q, r.n, r.c, window(mean[k, now[k]])))
            if r.c is not None:
                alphas[k] = min(max(alphas[k] + rate(t + 1) * (alpha - (1 - r.c)), low), high)
    scratch.remove(spark, held)
    return spark.createDataFrame(out, f"`{series}` {kind['_k']}, `{step}` {kind['_t']}, alpha_t double, q double, n bigint, coverage double, window int")


def temporal_split(year: Column, fit_to: int, dev_to: int, cal_to: int) -> Column:
    """FIT, DEV, CAL or TEST by year."""
    return F.when(year <= fit_to, "FIT").when(year <= dev_to, "DEV").when(year <= cal_to, "CAL").otherwise("TEST")


def rolling_origins(panel: DataFrame, year: str, origins: list[int], cal_years: int = 1, dev_years: int = 1) -> DataFrame:
    """Each row once for every origin it has a role in: TEST in the origin's year, CAL, DEV and FIT before it."""
    held = panel.withColumn("origin", F.explode(F.array(*map(F.lit, origins)))).where(F.col(year) <= F.col("origin"))
    back = F.col("origin") - F.col(year)
    role = F.when(back == 0, "TEST").when(back <= cal_years, "CAL").when(back <= cal_years + dev_years, "DEV").otherwise("FIT")
    return held.withColumn("role", role)


def leave_one_out_folds(panel: DataFrame, group: str, year: Column, groups: DataFrame, dev_from: int, cal_from: int) -> DataFrame:
    """Each row once for every held-out group: TEST if it belongs to it, else FIT, DEV or CAL by year."""
    folds = panel.crossJoin(groups.select(F.col(group).alias("held_out")).distinct())
    role = F.when(F.col(group) == F.col("held_out"), "TEST").when(year >= cal_from, "CAL").when(year >= dev_from, "DEV").otherwise("FIT")
    return folds.withColumn("role", role)


def detrend(panel: DataFrame, year: str, y: str, fit: Column) -> DataFrame:
    """panel with `trend`, the line fitted to the rows with `fit`, and `residual`."""
    line = panel.where(fit).agg(F.regr_slope(y, year).alias("_b"), F.regr_intercept(y, year).alias("_a"))
    held = panel.crossJoin(F.broadcast(line)).withColumn("trend", F.col("_a") + F.col("_b") * F.col(year)).drop("_a", "_b")
    return held.withColumn("residual", F.col(y) - F.col("trend"))


def entity_baseline(panel: DataFrame, entity: str, residual: str, fit: Column) -> DataFrame:
    """panel with `baseline`: the entity's mean residual over the rows with `fit`, 0 if it has none."""
    means = panel.where(fit).groupBy(F.col(entity).alias("_e")).agg(F.avg(residual).alias("baseline"))
    return panel.join(means, F.col(entity) == F.col("_e"), "left").drop("_e").withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))


def fit_only_imputation(panel: DataFrame, group: str, columns: list[str], fit: Column) -> DataFrame:
    """Nulls become the group's median over the rows with `fit`, or the overall one."""
    held = panel
    for c in columns:
        own, overall = quantiles_with_pool(panel.where(fit).select(F.col(group).alias("_g"), F.col(c).alias("_v")), "_g", "_v", lambda n: F.lit(0.5))
        held = held.join(own.select(F.col("_g"), F.col("q").alias("_m")), F.col(group) == F.col("_g"), "left").crossJoin(F.broadcast(overall.agg(F.max("q").alias("_o"))))
        held = held.withColumn(c, F.coalesce(c, "_m", "_o")).drop("_g", "_m", "_o")
    return held


def conformal_stratified(cal: DataFrame, test: DataFrame, group: str, alpha: float = 0.1) -> DataFrame:
    """As conformal_by_group(), but groups that calibration has not seen keep their bounds."""
    score = F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")).alias("s")
    own = quantile_at(cal.select(F.col(group).alias("_g"), score), ["_g"], "s", lambda n: level(alpha, n)).select("_g", F.col("q").alias("_q"))
    held = test.join(own, F.col(group) == F.col("_g"), "left").withColumn("_q", F.coalesce("_q", F.lit(0.0)))
    return held.withColumn("lo", F.col("lo") - F.col("_q")).withColumn("hi", F.col("hi") + F.col("_q")).drop("_g", "_q")


def repair_bounds(rows: DataFrame) -> DataFrame:
    """rows with lo and hi that cross set to their middle."""
    middle, crossed = (F.col("lo") + F.col("hi")) / 2, F.col("lo") > F.col("hi")
    return rows.withColumns({c: F.when(crossed, middle).otherwise(F.col(c)) for c in ("lo", "hi")})


def calibration_checks(rows: DataFrame, method: str, keys: list[str]) -> DataFrame:
    """(method, rows, negative_widths, nulls, differs, ok): widths that are not negative, and intervals unlike the first method's."""
    rows = scratch.materialize(rows, "checked-intervals")  # bounds that are made twice may differ in their last bit
    first = rows.agg(F.min(method).alias("_m"))
    base = rows.join(F.broadcast(first), F.col(method) == F.col("_m")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    held = rows.join(base, on, "left")
    out = held.groupBy(method).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("hi") < F.col("lo")).alias("negative_widths"), F.count_if(F.col("lo").isNull() | F.col("hi").isNull()).alias("nulls"),
        F.count_if((F.col("lo") != F.col("_lo")) | (F.col("hi") != F.col("_hi"))).alias("differs"),
    )
    return out.withColumn("ok", (F.col("negative_widths") == 0) & (F.col("nulls") == 0))


def coverage_interval(covered: Column, n: Column, z: float = 1.959963984540054) -> list[Column]:
    """Wald interval of a coverage share, held within [0, 1]."""
    half = z * F.sqrt(covered * (1 - covered) / n)
    return [F.greatest(covered - half, F.lit(0.0)).alias("wald_lo"), F.least(covered + half, F.lit(1.0)).alias("wald_hi")]


def conditional_coverage(rows: DataFrame, axes: list[str], method: str, least: int = 20) -> DataFrame:
    """(method, axis, stratum, n, coverage, rank, worst) on every axis; strata under `least` rows are left out of ranks.

    All axes are unpivoted and grouped in one pass. rank 1 is the method with the lowest coverage in the stratum.
    """
    covered = ((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("int")
    long = rows.select(method, covered.alias("_c"), *[F.col(a).cast("string").alias(a) for a in axes]).unpivot([method, "_c"], axes, "axis", "stratum")
    cells = long.groupBy(method, "axis", "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("_c").alias("coverage")).where(F.col("n") >= least)
    within, own = Window.partitionBy("axis", "stratum").orderBy("coverage"), Window.partitionBy(method, "axis").orderBy("coverage", "stratum")
    return cells.withColumn("rank", F.rank().over(within)).withColumn("worst", F.row_number().over(own) == 1)
