"""Hand-computed cases and properties of the panel operators."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.functions import scalars, special
from loomspan.operators import aggregates, audits, indices, joins, models, ordering, preprocess
from loomspan.operators import inference as inf
from loomspan.operators import intervals as iv
from loomspan.operators import timeseries as ts


def test_interval_metrics_by_hand(spark):
    rows = spark.createDataFrame([(10.0, 9.0, 11.0), (9.0, 9.5, 11.0), (8.0, 7.0, 9.0), (12.0, 9.0, 11.0)], "y double, lo double, hi double")
    m = rows.agg(*iv.interval_metrics(0.1)).first()
    assert (m.picp, m.unsafe_miss_rate, m.n_unsafe, m.over_rate) == (0.5, 0.25, 1, 0.25)
    assert m.mean_shortfall == m.worst_shortfall == 0.5 and m.expected_shortfall == 0.125
    assert m.mpiw == 1.875 and m.winkler == pytest.approx(9.375) and m.ace == pytest.approx(-0.4) and m.abs_ace == pytest.approx(0.4)


def test_strict_rolling_sum_needs_every_day(spark):
    rows = [("a", datetime.date(2024, 1, d), v) for d, v in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0], 1)]
    got = ts.strict_rolling_sum(spark.createDataFrame(rows, "entity string, day date, value double"), 3).orderBy("day")
    assert [r.rolled for r in got.collect()] == [None, None, None, None, None, 15.0, 18.0]


def test_episodes_equal_a_state_machine(spark):
    rnd = random.Random(4)
    flags = [rnd.random() < 0.5 for _ in range(60)]
    rows = [("a", datetime.date(2024, 1, 1) + datetime.timedelta(d), f, float(d)) for d, f in enumerate(flags)]
    got = ts.episodes(spark.createDataFrame(rows, "entity string, day date, flag boolean, severity double")).orderBy("start").collect()
    want, run = [], []
    for d, f in enumerate([*flags, False]):
        if f:
            run.append(d)
        elif run:
            want.append((len(run), float(run[-1])))
            run = []
    assert [(r.days, r.severity) for r in got] == want


def test_average_ranks_equal_pandas(spark):
    rnd = random.Random(1)
    data = pd.DataFrame({"g": [rnd.choice("ab") for _ in range(80)], "i": range(80), "v": [rnd.choice([None, 1.0, 2.0, 3.0, 5.0]) for _ in range(80)]})
    rows = [(r.g, r.i, None if pd.isna(r.v) else r.v) for r in data.itertuples()]
    got = spark.createDataFrame(rows, "g string, i int, v double").select("i", ts.percent_rank("v", "g").alias("p")).toPandas().set_index("i").p.sort_index()
    want = data.groupby("g").v.rank(pct=True)
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("n", [5, 8, 37, 100])
def test_equal_count_bins_equal_pandas(spark, n):
    got = spark.range(1, n + 1).select(ts.equal_count_bin(F.col("id"), F.lit(n), 5).alias("b")).toPandas().b
    assert (got.to_numpy() == pd.qcut(np.arange(1, n + 1), 5, labels=False) + 1).all()


def test_conformal_threshold_equals_numpy_and_covers(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(10, 1, 3000)
    df = spark.createDataFrame([(int(i), float(v), 9.5, 10.5, "a" if i % 10 else "b") for i, v in enumerate(y)], "i int, y double, lo double, hi double, g string")
    cal, test = df.where("i < 1500"), df.where("i >= 1500")
    scores = np.maximum(9.5 - y[:1500], y[:1500] - 10.5)
    q = np.quantile(scores, min(math.ceil(0.9 * 1501) / 1500, 1))
    out = iv.conformal_static(cal, test).select((F.lit(9.5) - F.col("lo")).alias("q"), F.col("y").between(F.col("lo"), F.col("hi")).alias("c")).toPandas()
    assert out.q.to_numpy() == pytest.approx(q) and out.c.mean() > 0.87
    few = cal.where("i < 40").withColumn("g", F.when(F.col("i") < 5, "b").otherwise("a"))
    by = iv.conformal_by_group(few, test, "g").groupBy("g").agg(F.avg(F.col("hi") - F.col("lo")).alias("w")).toPandas().set_index("g").w
    pooled = np.quantile(scores[:40], min(math.ceil(0.9 * 41) / 40, 1))
    assert by["b"] == pytest.approx(1 + 2 * pooled)


def test_shifted_conformal_weighs_scores_by_the_odds_of_test_rows(spark):
    rng = np.random.default_rng(9)
    x, z = rng.normal(0, 1, (400, 2)), rng.normal((1.5, 0), 1, (300, 2))
    y = rng.normal(0, 1, 400) * np.exp(x[:, 0])
    schema = "a double, b double, y double, lo double, hi double"
    cal = spark.createDataFrame([(*map(float, v), float(t), -0.5, 0.5) for v, t in zip(x, y)], schema)
    test = spark.createDataFrame([(*map(float, v), 0.0, -0.5, 0.5) for v in z], schema)
    both, label, w = np.c_[np.ones(700), np.r_[x, z]], np.r_[np.zeros(400), np.ones(300)], np.zeros(3)
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-both @ w))
        w -= np.linalg.solve((both * (p * (1 - p))[:, None]).T @ both + np.diag([0, 1, 1]), both.T @ (p - label) + np.r_[0, w[1:]])
    p = np.clip(1 / (1 + np.exp(-both[:400] @ w)), 0.01, 0.99)
    s, odds = np.maximum(-0.5 - y, y - 0.5), p / (1 - p)
    order = np.argsort(s)
    q = s[order][np.searchsorted(np.cumsum(odds[order]) / odds.sum(), 0.9)]
    got = iv.conformal_shifted(cal, test, ["a", "b"]).collect()
    assert len(got) == 300 and all(r.lo == pytest.approx(-0.5 - q) and r.hi == pytest.approx(0.5 + q) for r in got)
    plain = iv.conformal_static(cal, test).first()
    assert got[0].hi > 1.2 * plain.hi
    crossed = iv.conformal_shifted(cal.withColumn("y", F.lit(0.0)), test.withColumn("lo", F.lit(-0.1)).withColumn("hi", F.lit(0.3)), ["a", "b"]).first()
    assert crossed.lo == crossed.hi == pytest.approx(0.1)


def test_adaptive_conformal_moves_alpha(spark):
    rng = np.random.default_rng(2)
    rows = [("s", t, float(rng.normal(0, 1 + t)), -1.0, 1.0) for t in range(5) for _ in range(200)]
    out = iv.adaptive_conformal(spark.createDataFrame(rows, "s string, t int, y double, lo double, hi double"), "s", "t").orderBy("t").collect()
    assert out[0].q == 0 and out[0].alpha_t == 0.1 and all(0.01 <= r.alpha_t <= 0.4 for r in out)
    assert out[1].alpha_t < 0.1  # the first step missed more than alpha


def test_perturbing_a_later_part_does_not_move_the_fit(spark):
    base = [(e, y, float(e + y % 5)) for e in range(4) for y in range(1995, 2002)]
    moved = [(e, y, v if y <= 1997 else 1e6) for e, y, v in base]
    fit = lambda rows: iv.entity_baseline(iv.detrend(spark.createDataFrame(rows, "e int, y int, v double"), "y", "v", F.col("y") <= 1997), "e", "residual", F.col("y") <= 1997).select("e", "y", "trend", "baseline").toPandas().sort_values(["e", "y"]).to_numpy()
    assert np.allclose(fit(base), fit(moved))


def test_audit_counts_repeats_and_refuses_clashes(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, l string")
    right = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, r string")
    joined, audit = joins.audited_left_join(left, right, ["k"], "s")
    a = audit.first()
    assert joined.count() == a.rows_after == 3 and (a.left_repeated, a.right_repeated, a.left_unmatched, a.right_unmatched, a.ok) == (1, 1, 1, 1, False)
    with pytest.raises(ValueError, match="both sides"):
        joins.audited_left_join(left, right.withColumnRenamed("r", "l"), ["k"], "s")


def test_incomplete_gamma_and_normal_scores(spark):
    x = np.array([0.1, 0.5, 1.0, 2.0, 5.0, 20.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1)
    got = df.select("x", special.lower_gamma(F.lit(1.0), F.col("x")).alias("a"), special.lower_gamma(F.lit(2.0), F.col("x")).alias("b"), special.log_gamma(F.col("x")).alias("g")).toPandas()
    assert np.allclose(got.a, 1 - np.exp(-got.x), atol=1e-9) and np.allclose(got.b, 1 - np.exp(-got.x) * (1 + got.x), atol=1e-9)
    assert np.allclose(got.g, [math.lgamma(v) for v in got.x], atol=1e-9)
    tails = df.select(special.student_two_sided(F.lit(2.228138852), F.lit(10.0)).alias("t"), special.normal_two_sided(F.lit(1.959963985)).alias("z"), special.binomial_two_sided(F.lit(2), F.lit(10)).alias("b"), special.chi2_sf(F.lit(5.991464547), F.lit(2.0)).alias("c")).first()
    assert np.allclose(tails, [0.05, 0.05, 0.109375, 0.05], atol=1e-8)
    got = spark.createDataFrame([(0.5,), (0.975,), (0.001,)], "p double").select(scalars.probit(F.col("p")).alias("z")).toPandas().z
    assert np.allclose(got, [0.0, 1.959963985, -3.090232306], atol=1e-7)


def test_parsers(spark):
    rows = spark.createDataFrame([("10.5K", "(D)", "EF3"), ("2M", "1,234", "F0"), ("x", "", "none"), (None, None, None)], "m string, c string, t string")
    got = rows.select(scalars.money(F.col("m")).alias("m"), scalars.coded_number(F.col("c")).alias("c"), scalars.tornado_scale(F.col("t")).alias("t")).collect()
    assert [r.m for r in got] == [10500.0, 2e6, None, None]
    assert [(r.c.value, r.c.status) for r in got] == [(None, "withheld"), (1234.0, "ok"), (None, "missing"), (None, "missing")]
    assert [r.t for r in got] == [3.0, 0.0, None, None]


def test_profile_corrections_equal_pandas(spark):
    v = np.random.default_rng(1).gamma(2, size=50)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = df.agg(aggregates.skewness("v").alias("s"), aggregates.kurtosis("v").alias("k")).first()
    assert got.s == pytest.approx(pd.Series(v).skew()) and got.k == pytest.approx(pd.Series(v).kurt())


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    got = inf.adjust_p(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "test int, p double")).orderBy("test").toPandas()
    assert np.allclose(got.holm, [0.03, 0.06, 0.06, 0.02]) and np.allclose(got.bh, [0.02, 0.04, 0.04, 0.02])


def test_cluster_bootstrap_summary_by_hand(spark):
    rnd = random.Random(8)
    rows = [(c, rnd.gauss(1.0 + c % 3, 0.5)) for c in range(12) for _ in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(rows, "c int, v double")
    got = inf.cluster_bootstrap_summary(df, "c", "v").first()
    by = [[v for k, v in rows if k == c] for c in range(12)]

    def pick(d, slot):
        a = (42 + d * 7919 + slot * 104729) % 2147483647
        return by[(((a * 48271 + 11) % 2147483647) * 69621 + 7) % 2147483647 % 12]

    means = [np.mean([v for slot in range(12) for v in pick(d, slot)]) for d in range(2000)]
    assert np.allclose((got.estimate, got.lo, got.hi, got.se), (np.mean([v for _, v in rows]), *np.percentile(means, [2.5, 97.5]), np.std(means, ddof=1)))
    assert got.p_value == 1 / 2000 and got.n_draws == 2000 and got.n_clusters == 12 and got.n_observations == len(rows) and got.supported
    none = inf.cluster_bootstrap_summary(df.withColumn("v", F.lit(0.0)), "c", "v").first()
    assert none.p_value == 1.0 and none.lo == none.hi == 0
    few = inf.cluster_bootstrap_summary(df.where("c < 4"), "c", "v").first()
    assert few.estimate == pytest.approx(np.mean([v for c, v in rows if c < 4])) and few.lo is None and few.hi is None and few.se is None and few.p_value is None and not few.supported


def test_nearest_or_within(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "point int, x double, y double")
    sites = spark.createDataFrame([(10, 1.0, 0.0), (11, 2.0, 0.0), (12, 90.0, 50.0)], "site int, x double, y double")
    got = {(r.point, r.site) for r in joins.within_or_nearest(pts, sites, 5.0, 5.0).collect()}
    assert got == {(1, 10), (1, 11), (2, 12)}


def test_nearest_reaches_every_site_and_keeps_points_without_one(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 700.0, 1.0), (3, None, 1.0), (4, -1300.0, 0.0)], "point int, x double, y double")
    sites = spark.createDataFrame([(10, 1.0, 0.0), (11, -300.0, 0.0)], "site int, x double, y double")
    got = {(r.point, r.site, r.distance) for r in joins.within_or_nearest(pts, sites, 1.0, 1.0).collect()}
    assert got == {(1, 10, 1.0), (2, 10, math.hypot(699, 1)), (3, None, None), (4, 11, 1000.0)}
    assert {(r.point, r.site) for r in joins.within_or_nearest(pts, sites.limit(0), 1.0, 1.0).collect()} == {(i, None) for i in (1, 2, 3, 4)}


def test_trees_and_selection_find_the_feature_that_matters(spark):
    rnd = random.Random(5)
    rows = [(i, float(i % 10), rnd.random(), 5.0 * (i % 10) + rnd.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, signal double, noise double, y double")
    fit, dev, test = F.col("i") < 300, F.col("i").between(300, 449), F.col("i") >= 450
    out = models.tree_intervals(df, ["signal", "noise"], "y", fit, dev).where(test)
    found = out.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("pred"), F.lit(2)))).alias("rmse"), F.avg(((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("int")).alias("picp")).first()
    assert found.rmse < 2 and found.picp > 0.75
    votes = {r.feature: r for r in models.consensus_selection(df, ["signal", "noise"], "y", fit, share=0.5).collect()}
    assert votes["signal"].selected and votes["signal"].votes == 4 and votes["noise"].votes == 0
    left = {r.left_out: r.change for r in models.ablation(df, {"a": ["signal"], "b": ["noise"]}, "y", fit, test).collect()}
    assert left["a"] > 5 > abs(left["b"])
    wide = df.select("signal", "noise", "y", (F.col("signal") * 2 + F.col("noise") * 1e-3).alias("twin"))
    assert {r.column: r.kept for r in models.prune_columns(wide, ["signal", "noise", "twin"], "y", F.lit(True)).collect()}["noise"]
    assert sum(r.kept for r in models.prune_columns(wide, ["signal", "noise", "twin"], "y", F.lit(True)).collect()) == 2
    assert [r.twin for r in models.near_duplicate_columns(wide, ["signal", "noise", "twin"], F.lit(True), least=100).collect()] == [None, None, "signal"]


def test_running_sums_and_quantiles_over_ranges(spark):
    rnd = np.random.default_rng(3)
    values = np.round(rnd.normal(size=500), 2)
    df = spark.createDataFrame([(("a", "b")[i % 5 == 0], float(v)) for i, v in enumerate(values)], "k string, v double").repartition(5)
    got = ordering.quantiles(df, "v", {"q": F.lit(0.37)}).first()
    assert got.n == 500 and abs(got.q - np.quantile(values, 0.37)) < 1e-12
    by = {r.k: r.q for r in ordering.quantiles_by(df, ["k"], "v", lambda n: F.lit(0.9)).collect()}
    assert abs(by["b"] - np.quantile(values[::5], 0.9)) < 1e-12
    assert ordering.quantiles(df.limit(0), "v", {"q": F.lit(0.5)}).first().q is None


def test_preprocessing_fails_fast_and_strict_sums_skip_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "k int, v double")
    with pytest.raises(ValueError, match="v: 2 null or NaN, first at 2"):
        preprocess.require_complete(df, ["k"], ["v"])
    days = spark.createDataFrame([(1, datetime.date(2024, 1, d), float("nan") if d == 3 else 1.0) for d in range(1, 8)], "entity int, day date, value double")
    got = [r.rolled for r in ts.strict_rolling_sum(days, 2).orderBy("day").collect()]
    assert got == [None, 2.0, None, None, 2.0, 2.0, 2.0]
    with pytest.raises(ValueError, match="missing columns: target.y"):
        audits.require_columns(df, {"key": ["k"], "target": ["y"]})
    flat = spark.createDataFrame([("e", i, 2.0) for i in range(12)], "e string, o int, v double")
    assert indices.gamma_fit(flat, ["e"], "v").first().shape is None


def test_feature_block_is_one_grouped_pass(spark):
    rows = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 3, 30.0), ("b", 1, None), ("b", 4, 5.0)], "k string, day int, v double")
    features = [aggregates.Feature("v", F.col("v"), ("mean", "min", "max", "total", "valid")), aggregates.Feature("hot", F.col("v"), ("count",), F.col("v") > 8)]
    windows = {"all": F.lit(True), "early": F.col("day") <= 2, "none": F.col("day") > 9, "unknown": F.lit(None).cast("boolean")}
    out = aggregates.feature_block(rows, ["k"], windows, features, mean_share=0.5, total_share=1.0)
    got = {r.k: r.asDict() for r in out.collect()}
    a, b = got["a"], got["b"]
    assert (a["days_all"], a["v_mean_all"], a["v_min_all"], a["v_max_all"], a["v_total_all"], a["v_valid_all"], a["hot_count_all"]) == (3, 20.0, 10.0, 30.0, None, 2, None)
    assert (a["v_mean_early"], a["v_total_early"]) == (10.0, None) and (b["v_mean_early"], b["v_valid_early"]) == (None, 0)
    assert (a["days_none"], a["v_total_none"], a["v_mean_none"], a["hot_count_none"]) == (0, 0.0, None, 0) and a["days_unknown"] == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and len(out.columns) == 29
    assert aggregates.feature_block(rows.limit(0), ["k"], windows, features).count() == 0
