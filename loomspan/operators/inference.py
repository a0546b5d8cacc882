"""Inference that respects clusters: resampling on per-cluster sums, corrections, rank tests and drift."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomspan import scratch
from loomspan.functions import special
from loomspan.operators import audits
from loomspan.operators.ordering import edges, running_sums


def draw(seed: Column, draw: Column, slot: Column, n: Column) -> Column:
    """A pseudo-random number from 0 to n - 1 by integer arithmetic that any SQL engine repeats."""
    a = (seed + draw * 7919 + slot * 104729) % 2147483647
    b = (a * 48271 + 11) % 2147483647
    return ((b * 69621 + 7) % 2147483647) % n


#: Draws are dealt to this many tasks, and clusters to pieces of at most this many: a task holds one piece.
DRAW_BLOCKS, CLUSTER_PIECE = 24, 1 << 19


def resample_clusters(rows: DataFrame, cluster: str, sums: dict[str, Column], draws: int, seed: int = 42) -> DataFrame:
    """(draw, the sums) of resampled clusters. Clusters are reduced to their sums first, so a draw costs one pick a cluster.

    Clusters are numbered over range partitions. A task holds one piece of them for some of the draws, counts how often each
    is picked and adds up by these counts, so no row a pick is made, joined or sent. With c pieces, picks are made c times.
    """
    per = rows.groupBy(F.col(cluster).alias("c")).agg(*[v.alias(k) for k, v in sums.items()], F.lit(1).alias("_one"))
    whole = [isinstance(per.schema[n].dataType, IntegralType) for n in sums]
    held = running_sums(per, "c", "_one").withColumn("i", F.col("up_to__one") - 1).drop("c", "_one", "up_to__one")
    k = held.agg(F.count(F.lit(1)).alias("k"))
    names, kind = list(sums), ["bigint" if w else "double" for w in whole]
    plain = held.crossJoin(F.broadcast(k)).select("i", "k", F.floor(F.col("i") / CLUSTER_PIECE).alias("piece"), *[F.col(n).cast(t).alias(n) for n, t in zip(sums, kind, strict=True)])
    dealt = plain.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(DRAW_BLOCKS - 1))))

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        block, base, n = key[0].as_py(), key[1].as_py() * CLUSTER_PIECE, part.num_rows
        slots, own = part["k"][0].as_py(), np.arange(block, draws, DRAW_BLOCKS)
        order = np.argsort(part["i"].to_numpy())
        some = [part[c].is_valid().to_numpy()[order] for c in names]
        values = [part[c].fill_null(0).to_numpy()[order] for c in names]
        out = [[] for _ in names]
        for d in own:
            times = np.zeros(n, np.int64)
            for at in range(0, slots, CLUSTER_PIECE):
                i = (seed + int(d) * 7919 + np.arange(at, min(at + CLUSTER_PIECE, slots)) * 104729) % 2147483647  # draw() of many slots
                i = ((i * 48271 + 11) % 2147483647 * 69621 + 7) % 2147483647 % slots - base
                times += np.bincount(i if slots <= n else i[(i >= 0) & (i < n)], minlength=n)
            for o, v, there in zip(out, values, some, strict=True):
                picked = there & (times > 0)  # a cluster without a pick adds nothing, be it infinite
                o.append((times[picked] * v[picked]).sum() if picked.any() else None)
        return pa.table([pa.array(own.astype(np.int32)), *[pa.array(o, pa.int64() if w else pa.float64()) for o, w in zip(out, whole, strict=True)]], names=["draw", *names])

    each = dealt.groupBy("block", "piece").applyInArrow(run, "draw int, " + ", ".join(f"`{n}` {t}" for n, t in zip(sums, kind, strict=True)))
    return each.groupBy("draw").agg(*[F.sum(n).alias(n) for n in sums])


def cluster_bootstrap_mean(rows: DataFrame, cluster: str, value: str, draws: int, seed: int = 42) -> DataFrame:
    """(draw, mean): means of resampled clusters."""
    sums = resample_clusters(rows, cluster, {"n": F.count(value), "s": F.sum(value)}, draws, seed)
    return sums.select("draw", (F.col("s") / F.col("n")).alias("mean"))


def bootstrap_table(rows: DataFrame, cluster: str, sums: dict[str, Column], stats: dict[str, Column], draws: int = 2000, alpha: float = 0.05, least: int = 5, valid: float = 0.8, seed: int = 42) -> DataFrame:
    """(stat, estimate, lo, hi, se, p_value, n_draws, supported) of any statistics of cluster sums.

    stats are columns over the sums. p_value is two-sided for a statistic of 0. Bounds, error and p-value are null with
    fewer than `least` clusters, or where fewer than `valid` of the draws give a number.
    """
    per = rows.groupBy(F.col(cluster).alias("_c")).agg(*[v.alias(k) for k, v in sums.items()])
    whole = per.agg(F.count(F.lit(1)).alias("_k"), *[F.sum(k).alias(k) for k in sums])
    whole = whole.select("_k", *[v.cast("double").alias(k) for k, v in stats.items()]).unpivot(["_k"], list(stats), "stat", "estimate")
    each = resample_clusters(rows, cluster, sums, draws, seed).select(*[v.cast("double").alias(k) for k, v in stats.items()]).unpivot([], list(stats), "stat", "b")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    b = F.col("b")
    over = each.where(b.isNotNull()).groupBy("stat").agg(
        F.percentile(b, F.lit(alpha / 2)).alias("lo"), F.percentile(b, F.lit(1 - alpha / 2)).alias("hi"), F.stddev_samp(b).alias("se"),
        F.least(F.lit(1.0), F.greatest(2 * F.least(share(b <= 0), share(b >= 0)), F.lit(1 / draws))).alias("p_value"), F.count(b).alias("n_draws"),
    )
    good = (F.col("_k") >= least) & (F.col("n_draws") >= valid * draws)
    out = whole.join(F.broadcast(over), "stat", "left").withColumn("supported", F.coalesce(good, F.lit(False)))
    return out.withColumns({c: F.when(F.col("supported"), F.col(c)) for c in ("lo", "hi", "se", "p_value")}).drop("_k")


def paired_test(pairs: DataFrame, block: str, a: str, b: str) -> DataFrame:
    """One row from block means of a - b: n, mean_difference, t, p_value, cohen_dz, wins, losses, sign_p."""
    per = pairs.groupBy(block).agg(F.avg(F.col(a) - F.col(b)).alias("d"))
    one = per.agg(F.count("d").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("_s"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"))
    one = one.withColumn("t", F.col("mean_difference") / F.nullif(F.col("_s"), F.lit(0.0)) * F.sqrt("n"))
    out = one.withColumn("p_value", special.student_two_sided(F.col("t"), F.col("n") - 1.0)).withColumn("cohen_dz", F.col("mean_difference") / F.nullif(F.col("_s"), F.lit(0.0)))
    return out.withColumn("sign_p", special.binomial_two_sided(F.col("wins"), F.col("wins") + F.col("losses"))).drop("_s")


def two_arm_verdict(a: DataFrame, b: DataFrame, keys: list[str], loss: str, block: str, alpha: float = 0.05) -> DataFrame:
    """One row for two arms of an experiment on the same rows: rows, blocks, loss_a, loss_b, mean_difference, t, p_value, cohen_dz, wins, losses, sign_p, verdict.

    Losses are compared by block, a less b. The verdict names the arm with the smaller loss where the paired test is below
    alpha, else `tie`. A row that only one arm has, or has twice, makes whatever reads the result fail: the arms are not matched then.
    """
    side = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{name}"), F.first(block).alias(f"_b{name}"), F.first(loss).cast("double").alias(f"_{name}"))
    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    matched = F.count_if((F.coalesce("_na", F.lit(0)) != 1) | (F.coalesce("_nb", F.lit(0)) != 1))
    held = audits.gate(both, {"unmatched": matched}, F.col("_gate_unmatched") == 0, "matched arms").select(F.coalesce("_ba", "_bb").alias("block"), "_a", "_b")
    totals = held.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("block").alias("blocks"), F.avg("_a").alias("loss_a"), F.avg("_b").alias("loss_b"))
    out = totals.crossJoin(F.broadcast(paired_test(held, "block", "_a", "_b").drop("n")))
    better = F.when(F.col("mean_difference") < 0, "a").otherwise("b")
    return out.withColumn("verdict", F.when(F.col("p_value") < alpha, better).otherwise("tie"))


def signed_rank(pairs: DataFrame, block: str, a: str, b: str) -> DataFrame:
    """One row: Wilcoxon's signed-rank statistic of block means of a - b (zeros left out, ties averaged), with its normal p-value."""
    per = pairs.groupBy(block).agg(F.avg(F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    # equal sizes share a mean rank: sizes are counted first and ranked by running counts
    sizes = running_sums(per.groupBy(F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("up")), "size", "c")
    rank = F.col("up_to_c") - (F.col("c") - 1) / 2
    one = sizes.agg(F.sum("c").alias("n"), F.sum(rank * F.col("up")).alias("plus"), F.sum(rank * (F.col("c") - F.col("up"))).alias("minus"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("_ties"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    w = F.least("plus", "minus")
    return one.select("n", w.alias("w"), special.normal_two_sided((w - n * (n + 1) / 4) / F.nullif(spread, F.lit(0.0))).alias("p_value"))


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: Kruskal and Wallis' H of the groups (corrected for ties), degrees and p-value."""
    cells = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v"), F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    cells = scratch.materialize(cells, "kruskal-cells")  # a value that is made twice may differ in its last bit, and would then find no rank
    values = running_sums(cells.groupBy("v").agg(F.sum("c").alias("c")), "v", "c")
    rank = F.col("up_to_c") - (F.col("c") - 1) / 2
    ranks = values.select(F.col("v").alias("_v"), rank.alias("rank"))
    per = cells.join(ranks, F.col("v") == F.col("_v")).groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("s"))
    total = per.agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"), F.count(F.lit(1)).alias("k"))
    ties = values.agg(F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    one = total.crossJoin(F.broadcast(ties)).select(h.alias("h"), (F.col("k") - 1).alias("df"))
    return one.withColumn("p_value", special.chi2_sf(F.col("h"), F.col("df")))


def nemenyi(ranked: DataFrame, method: str, alpha: float = 0.05) -> DataFrame:
    """(left, right, difference, cd, significant) for pairs of methods of friedman(), of any number.

    The critical difference comes from the range of as many normal variables as there are methods; their number is the one
    figure that is read from the data before the plan is made.
    """
    k = ranked.count()
    q = special.range_quantile(k, alpha) / math.sqrt(2) if k > 1 else math.nan
    a = ranked.select(F.col(method).alias("left"), F.col("mean_rank").alias("_a"), (F.lit(q * math.sqrt(k * (k + 1) / 6)) / F.sqrt(F.col("blocks").cast("double"))).alias("cd"))
    b = ranked.select(F.col(method).alias("right"), F.col("mean_rank").alias("_b"))
    pairs = a.join(b, F.col("left") < F.col("right")).withColumn("difference", F.abs(F.col("_a") - F.col("_b")))
    return pairs.select("left", "right", "difference", "cd", (F.col("difference") > F.col("cd")).alias("significant"))


def cluster_bootstrap_summary(rows: DataFrame, cluster: str, value: str, draws: int = 2000, alpha: float = 0.05, least: int = 5, seed: int = 42) -> DataFrame:
    """One row: estimate, n_clusters, n_observations, percentile bounds lo and hi, se, p_value (two-sided, of a mean of 0), n_draws, supported.

    With fewer than `least` clusters only the estimate and the counts are given.
    """
    rows = rows.where(F.col(value).isNotNull())
    whole = rows.groupBy(F.col(cluster).alias("c")).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    whole = whole.agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("estimate"), F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_observations"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    b = F.col("mean")
    over = cluster_bootstrap_mean(rows, cluster, value, draws, seed).agg(
        F.percentile(b, F.lit(alpha / 2)).alias("lo"), F.percentile(b, F.lit(1 - alpha / 2)).alias("hi"), F.stddev_samp(b).alias("se"),
        F.least(F.lit(1.0), F.greatest(2 * F.least(share(b <= 0), share(b >= 0)), F.lit(1 / draws))).alias("p_value"), F.count(b).alias("n_draws"),
    )
    enough = F.col("n_clusters") >= least
    out = whole.crossJoin(F.broadcast(over))
    return out.withColumns({c: F.when(enough, F.col(c)) for c in ("lo", "hi", "se", "p_value")} | {"n_draws": F.when(enough, F.col("n_draws")).otherwise(0), "supported": enough})


def adjust_p(tests: DataFrame, p: str = "p", *keys: str) -> DataFrame:
    """tests with Holm's and Benjamini-Hochberg's adjusted p-values within keys.

    Tests are placed in ranges of (keys, p, test). Each range is numbered and runs its own largest and smallest figures; those
    of the ranges before and after it, a row a key and range, are added on top.
    """
    placed = tests.withColumn("_k", F.struct(*keys) if keys else F.lit(0))
    placed = scratch.materialize(placed.withColumn("_at", F.struct("_k", p, "test")).repartitionByRange("_at").withColumn("_p", F.spark_partition_id()).drop("_at"), "p-ranges")
    by, within = Window.partitionBy("_k"), Window.partitionBy("_k", "_p")
    earlier, later = (by.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_p"), F.col("_p").desc()))
    ranges = placed.groupBy("_k", "_p").agg(F.count(F.lit(1)).alias("_c"))
    ranges = ranges.select("_k", "_p", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_b"), F.sum("_c").over(by).alias("_n"))
    held = placed.join(ranges, ["_k", "_p"]).withColumn("_r", F.col("_b") + F.row_number().over(within.orderBy(p, "test")))
    held = held.withColumns({"_h": F.least(F.col(p) * (F.col("_n") - F.col("_r") + 1), F.lit(1.0)), "_f": F.least(F.col(p) * F.col("_n") / F.col("_r"), F.lit(1.0))})
    ends = held.groupBy("_k", "_p").agg(F.max("_h").alias("_h"), F.min("_f").alias("_f"))
    ends = ends.select("_k", "_p", F.max("_h").over(earlier).alias("_top"), F.min("_f").over(later).alias("_low"))
    first = Window.unboundedPreceding
    out = held.join(ends, ["_k", "_p"]).withColumns({
        "holm": F.greatest(F.max("_h").over(within.orderBy("_r").rowsBetween(first, 0)), "_top"),
        "bh": F.least(F.min("_f").over(within.orderBy(F.col("_r").desc()).rowsBetween(first, 0)), "_low"),
    })
    return out.select(*tests.columns, "holm", "bh")


def intraclass(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    """One row: rows, clusters, intraclass correlation (0 at least), design effect and effective sample size."""
    by = rows.groupBy(cluster).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    t = by.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    between = (F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")) / (F.col("k") - 1)
    within = F.col("within") / (F.col("n") - F.col("k"))
    size = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)
    icc = F.greatest((between - within) / (between + (size - 1) * within), F.lit(0.0))
    t = t.withColumn("icc", icc).withColumn("design_effect", 1 + (F.col("n") / F.col("k") - 1) * F.col("icc"))
    return t.select("n", F.col("k").alias("clusters"), "icc", "design_effect", (F.col("n") / F.col("design_effect")).alias("effective_n"))


def cluster_robust_slope(rows: DataFrame, cluster: str, x: str, y: str) -> DataFrame:
    """One row: intercept, slope and the slope's cluster-robust (CR1) standard error. All sums are taken in two passes."""
    line = rows.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.avg(x).alias("mx"), F.count(F.lit(1)).alias("n"), F.regr_sxx(y, x).alias("sxx"))
    held = rows.crossJoin(F.broadcast(line)).withColumn("u", (F.col(x) - F.col("mx")) * (F.col(y) - F.col("a") - F.col("b") * F.col(x)))
    scores = held.groupBy(cluster).agg(F.sum("u").alias("u"))
    meat = scores.agg(F.sum(F.col("u") * F.col("u")).alias("meat"), F.count(F.lit(1)).alias("g"))
    factor = F.col("g") / (F.col("g") - 1) * (F.col("n") - 1) / (F.col("n") - 2)
    return line.crossJoin(meat).select(F.col("a").alias("intercept"), F.col("b").alias("slope"), (F.sqrt(factor * F.col("meat")) / F.col("sxx")).alias("slope_se"), F.col("g").alias("clusters"))


def cluster_robust_ols(rows: DataFrame, cluster: str, xs: list[str], y: str, alpha: float = 0.05, least: int = 5) -> DataFrame:
    """(term, coefficient, std_error, t, p_value, lo, hi, r_squared, n, clusters, supported) of ordinary least squares.

    Errors are robust to clusters, with the CR1 factor; bounds and p-values use one degree less than there are clusters. With
    fewer than `least` clusters they are null. Rows with a null in y or a regressor are left out; collinear regressors share
    their effect (the shortest solution). Two passes over the rows: moments, then score sums by cluster. Only moments of the
    regressors come to the driver, as many as pairs of regressors.
    """
    held = rows.select(F.col(cluster).alias("c"), F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)]).na.drop(subset=["y", *[f"x{i}" for i in range(len(xs))]])
    k = len(xs)
    names = [f"x{i}" for i in range(k)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    one = held.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in (*names, "y")], F.var_pop("y").alias("yy"), *[F.covar_pop(a, "y").alias(f"{a}_y") for a in names], *[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    schema = "term string, coefficient double, std_error double, t double, p_value double, lo double, hi double, r_squared double, n bigint, clusters bigint, supported boolean"
    n = one["n"]
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    xx = np.array([[one[f"{min(a, b)}_{max(a, b)}"] if f"{min(a, b)}_{max(a, b)}" in one.asDict() else one[f"{max(a, b)}_{min(a, b)}"] for b in names] for a in names]).reshape(k, k)
    xy, mean = np.array([one[f"{a}_y"] for a in names]), np.array([one[f"m_{a}"] for a in names])
    inverse = np.linalg.pinv(xx)
    b = inverse @ xy
    intercept = one["m_y"] - b @ mean
    # regressors around their means: the matrix is block-diagonal and no digits are lost
    centred = [F.lit(1.0), *[F.col(a) - float(m) for a, m in zip(names, mean, strict=True)]]
    u = F.col("y") - float(intercept)
    for a, v in zip(names, b, strict=True):
        u = u - F.col(a) * float(v)
    scores = held.withColumn("u", u).groupBy("c").agg(*[F.sum(x * F.col("u")).alias(f"s{i}") for i, x in enumerate(centred)], F.sum(F.col("u") * F.col("u")).alias("uu"))
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    two = scores.agg(F.count(F.lit(1)).alias("g"), F.sum("uu").alias("uu"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in cells]).first()
    meat, g = np.zeros((k + 1, k + 1)), two["g"]
    for i, j in cells:
        meat[i, j] = meat[j, i] = two[f"m{i}_{j}"]
    bread = np.zeros((k + 1, k + 1))
    bread[0, 0], bread[1:, 1:] = 1 / n, inverse / n
    shift = np.eye(k + 1)
    shift[0, 1:] = -mean  # back to the intercept at regressors of 0
    factor = g / max(g - 1, 1) * (n - 1) / max(n - k - 1, 1)
    errors = np.sqrt(np.maximum(np.diag(shift @ bread @ meat @ bread @ shift.T), 0) * factor)
    good = g >= least
    point = special.student_point(g - 1, alpha) if good else None
    r2 = 1 - two["uu"] / max(n * one["yy"], 1e-12)
    out = [(t, float(v), float(e) if good else None, float(v / e) if good and e > 0 else None, float(v - point * e) if good else None, float(v + point * e) if good else None) for t, v, e in zip(["intercept", *xs], [intercept, *b], errors, strict=True)]
    table = rows.sparkSession.createDataFrame(out, "term string, coefficient double, std_error double, t double, lo double, hi double")
    table = table.withColumns({"p_value": special.student_two_sided(F.col("t"), F.lit(float(g - 1))), "r_squared": F.lit(float(r2)), "n": F.lit(n).cast("bigint"), "clusters": F.lit(g).cast("bigint"), "supported": F.lit(good)})
    return table.select(*[c.split()[0] for c in schema.split(", ")])


#: Chances of at most 0, 1, 2, ... events under Poisson's law of mean 1, up to where all 31 bits are used up.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
PRIME = 2147483647


def poisson_limits() -> list[int]:
    """Whole numbers below PRIME: as many as are not above a uniform one give its Poisson count."""
    return [round(p * PRIME) for p in POISSON]


def _uniform(seed: int, slot: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 to PRIME - 1 for rows (slot) and draws, by squares modulo a prime, which any SQL engine repeats.

    The prime is 2^31 - 1, so a number's lower and upper bits add up to one with the same remainder, and no division is made.
    """
    slot, draw = (slot % PRIME).astype(np.uint64)[:, None], draw.astype(np.uint64)[None, :]
    prime, bits = np.uint64(PRIME), np.uint64(31)

    def add_bits(x: np.ndarray) -> None:
        np.right_shift(x, bits, out=high)
        np.bitwise_and(x, prime, out=x)
        np.add(x, high, out=x)

    h = (np.uint64(seed) + draw * np.uint64(7919)) % prime + slot * np.uint64(104729) % prime
    high = np.subtract(h, prime)  # wraps round to a large number below the prime
    np.minimum(h, high, out=h)
    g = np.multiply(h, h)
    g += slot
    add_bits(g)  # at most 2^32 - 1, whose square still leaves room for the next term
    np.multiply(g, g, out=g)
    g += (draw * np.uint64(48271) + np.uint64(11)) % prime
    add_bits(g)
    g *= np.uint64(69621)
    g += h
    add_bits(g)
    np.subtract(g, prime, out=high)
    return np.minimum(g, high, out=g).astype(np.int32)


def row_paired_bootstrap(rows: DataFrame, slot: str, y: str, a: str, b: str, draws: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(stat, a, b, delta, lo, hi) for rmse, mae and r2 of two predictions a and b of y: delta is b's less a's, with percentile bounds.

    Each row takes part in each draw as often as Poisson's law of mean 1 says, by a hash of its slot (a whole number, its
    own) and the draw. A task adds up all draws in one pass; a draw's six sums are all that leaves it, so no row is shuffled
    or copied. Rows with a null are left out. Without rows all figures are null.
    """
    limits = np.array(poisson_limits(), np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, every = np.zeros((draws + 1, 7)), np.arange(draws)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                slots, v, p, q = (c.to_numpy() for c in batch.slice(at, 256).columns)
                held = np.stack([np.ones(len(v)), np.abs(v - p), np.abs(v - q), (v - p) ** 2, (v - q) ** 2, v, v * v], axis=1)
                weights = np.zeros((len(v), draws))
                for i in range(0, len(v), 32):  # few rows at a time, whose figures stay in the cache
                    u, few = _uniform(seed, slots[i : i + 32], every), weights[i : i + 32]
                    times = np.zeros(u.shape, np.int8)
                    for limit in limits:
                        times += u >= limit
                    few[:] = times
                total[:draws] += weights.T @ held
                total[draws] += held.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, draws)), *[pa.array(np.roll(total, 1, axis=0)[:, i]) for i in range(7)]], ["draw", *sums])

    sums = ["n", "ma", "mb", "sa", "sb", "sy", "syy"]
    plain = rows.select(F.col(slot).cast("bigint"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate((y, a, b))]).na.drop()
    each = plain.mapInArrow(run, "draw bigint, " + ", ".join(f"{c} double" for c in sums)).groupBy("draw").agg(*[F.sum(c).alias(c) for c in sums]).where("n > 0")
    n, spread = F.col("n"), F.nullif(F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"), F.lit(0.0))
    stats = {"rmse": (F.sqrt(F.col("sa") / n), F.sqrt(F.col("sb") / n)), "mae": (F.col("ma") / n, F.col("mb") / n), "r2": (1 - F.col("sa") / spread, 1 - F.col("sb") / spread)}
    long = each.select("draw", F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), v.alias("a"), w.alias("b")) for k, (v, w) in stats.items()])).alias("s")).select("draw", "s.*")
    whole, drawn, delta = F.col("draw") == -1, F.col("draw") >= 0, F.col("b") - F.col("a")
    return long.groupBy("stat").agg(
        F.max(F.when(whole, F.col("a"))).alias("a"), F.max(F.when(whole, F.col("b"))).alias("b"), F.max(F.when(whole, delta)).alias("delta"),
        F.percentile(F.when(drawn, delta), F.lit(alpha / 2)).alias("lo"), F.percentile(F.when(drawn, delta), F.lit(1 - alpha / 2)).alias("hi"),
    )


def stability_index(before: DataFrame, after: DataFrame, column: str, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """One row: population stability index of `after` against the deciles of `before`, and its class."""
    cuts = edges(before, column, [i / bins for i in range(1, bins)]).select(F.array_distinct("e").alias("edges"))

    def share(df: DataFrame, name: str) -> DataFrame:
        held = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(cuts))
        binned = held.groupBy(F.size(F.filter("edges", lambda e: e < F.col(column))).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
        total = binned.agg(F.sum("c").alias("t"))
        return binned.crossJoin(F.broadcast(total)).select("bin", F.greatest(F.col("c") / F.col("t"), F.lit(eps)).alias(name))

    both = share(before, "p").join(share(after, "q"), "bin", "full_outer")
    p, q = F.coalesce("p", F.lit(eps)), F.coalesce("q", F.lit(eps))
    out = both.agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    return out.withColumn("drift", F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("large"))


def distribution_distance(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: Kolmogorov-Smirnov distance with its asymptotic p_value, and Wasserstein-1 distance, of two samples.

    Distinct values are counted, put in ranges, and summed up range by range; gaps between ranges are added at the end.
    """
    both = a.select(F.col(column).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(column, F.lit(0), F.lit(1))).where(F.col("v").isNotNull())
    values = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = values.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    held = running_sums(values, "v", "a", "b").crossJoin(F.broadcast(total)).withColumn("d", F.abs(F.col("up_to_a") / F.col("na") - F.col("up_to_b") / F.col("nb")))
    spread = held.repartitionByRange("v").withColumn("_p", F.spark_partition_id())
    spread = scratch.materialize(spread, "ecdf-ranges")
    w = Window.partitionBy("_p").orderBy("v")
    inner = spread.withColumn("gap", F.lead("v").over(w) - F.col("v")).agg(F.max("d").alias("ks"), F.sum(F.col("d") * F.coalesce("gap", F.lit(0.0))).alias("_w"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    ends = spread.groupBy("_p").agg(F.min("v").alias("_low"), F.max("v").alias("_high"), F.max_by("d", "v").alias("_d"))
    across = ends.withColumn("_gap", F.lead("_low").over(Window.orderBy("_p")) - F.col("_high")).agg(F.sum(F.col("_d") * F.coalesce("_gap", F.lit(0.0))).alias("_x"))
    one = inner.crossJoin(across).select("ks", (F.col("_w") + F.col("_x")).alias("wasserstein"), "na", "nb")
    return one.select("ks", "wasserstein", special.kolmogorov_sf(F.col("ks"), F.col("na"), F.col("nb")).alias("p_value"))


def friedman(scores: DataFrame, block: str, method: str, score: str, average_rank) -> DataFrame:
    """(method, mean_rank, chi2, blocks) of ranks within blocks, ties averaged."""
    ranked = scores.withColumn("_r", average_rank(score, block))
    means = ranked.groupBy(method).agg(F.avg("_r").alias("mean_rank"), F.count(F.lit(1)).alias("blocks"))
    k = means.agg(F.count(F.lit(1)).alias("_k"), F.sum(F.col("mean_rank") * F.col("mean_rank")).alias("_s"))
    chi2 = 12 * F.col("blocks") / (F.col("_k") * (F.col("_k") + 1)) * (F.col("_s") - F.col("_k") * F.pow(F.col("_k") + 1, F.lit(2)) / 4)
    return means.crossJoin(F.broadcast(k)).select(method, "mean_rank", chi2.alias("chi2"), "blocks")
