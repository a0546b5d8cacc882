"""Joins that refuse, masks of parts, the bootstrap of paired rows and cluster-robust least squares, against plain forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import special
from loomspan.operators import audits
from loomspan.operators import inference as inf


def test_join_chain_counts_each_step(spark):
    skeleton = spark.createDataFrame([(1, "a", 10), (1, "b", 11), (2, "a", 12), (None, "a", 13)], "k int, s string, v int")
    one = spark.createDataFrame([(1, 5, "x"), (3, None, "y"), (None, 7, "z")], "k int, v int, w string")
    two = spark.createDataFrame([("a", 1.5)], "s string, u double")
    out, audit = audits.join_chain(skeleton, [("first", one, ["k"]), ("second", two, ["s"])])
    assert sorted(map(tuple, out.select("k", "s", "v", "v_first", "w", "u").collect()), key=repr) == sorted([(1, "a", 10, 5, "x", 1.5), (1, "b", 11, 5, "x", None), (2, "a", 12, None, None, 1.5), (None, "a", 13, None, None, 1.5)], key=repr)
    assert list(map(tuple, audit.collect())) == [("first", 4, 4, 3, 5, 2, 3, 0, 2, 4), ("second", 4, 4, 5, 6, 1, 1, 0, 1, 1)]


@pytest.mark.parametrize("keys", [[1, 1, 2], [None, None, 2], [9, 9]])
def test_join_chain_refuses_repeated_keys(spark, keys):
    skeleton = spark.createDataFrame([(1, 10), (2, 11)], "k int, v int")
    table = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, w int")
    with pytest.raises(ValueError, match="later: 1 keys of k repeat"):
        audits.join_chain(skeleton, [("fine", skeleton.withColumnRenamed("v", "x"), ["k"]), ("later", table, ["k"])])


def test_join_chain_of_nothing(spark):
    none = spark.createDataFrame([], "k int, v int")
    out, audit = audits.join_chain(none, [("empty", none.withColumnRenamed("v", "w"), ["k"])])
    assert out.count() == 0 and tuple(audit.first())[:5] == ("empty", 0, 0, 2, 3)


def test_parts_share_keys_by_mask(spark):
    rows = [(1, "train"), (2, "train"), (2, "test"), (3, "dev"), (4, "cal"), (4, "cal"), (5, "es"), (5, "dev"), (5, "test"), (6, "else"), (None, "train"), (None, "es")]
    got = {r.label: (r.left_rows, r.right_rows, r.shared, r.verdict) for r in audits.disjoint_parts(spark.createDataFrame(rows, "id int, part string"), "id", "part").collect()}
    assert len(got) == 9
    assert got["train_test_overlap"] == (3, 2, 1, "FAIL") and got["validation_test_overlap"] == (2, 2, 1, "FAIL") and got["earlystop_test_overlap"] == (2, 2, 1, "FAIL")
    assert got["train_calibration_overlap"] == (3, 1, 0, "PASS") and got["earlystop_calibration_overlap"] == (2, 1, 0, "PASS")
    empty = audits.disjoint_parts(spark.createDataFrame([], "id int, part string"), "id", "part").collect()
    assert len(empty) == 9 and {(r.shared, r.verdict) for r in empty} == {(0, "PASS")}


def test_parts_take_one_shuffle_of_rows(spark):
    plan = audits.disjoint_parts(spark.range(100).select("id", F.lit("train").alias("part")), "id", "part")._jdf.queryExecution().toString()
    assert "Join" not in plan


def paired(n, seed=3):
    rnd = np.random.default_rng(seed)
    y = rnd.normal(size=n) * 10
    return [(i * 7 + 1, float(v), float(v + rnd.normal()), float(v + rnd.normal() * 1.5)) for i, v in enumerate(y)]


def test_row_bootstrap_equals_a_loop_over_draws(spark):
    rows = paired(200)
    df = spark.createDataFrame([*rows, (9, None, 1.0, 1.0)], "slot bigint, y double, a double, b double").repartition(5)
    draws, slots = 60, [r[0] for r in rows]
    y, a, b = np.array([r[1:] for r in rows]).T
    deltas = {"rmse": [], "mae": [], "r2": []}

    def scores(w, p):
        mean = (w * y).sum() / w.sum()
        sse = (w * (y - p) ** 2).sum()
        return {"rmse": math.sqrt(sse / w.sum()), "mae": (w * abs(y - p)).sum() / w.sum(), "r2": 1 - sse / (w * (y - mean) ** 2).sum()}

    for draw in range(draws):
        w = []
        for s in slots:
            h = (42 + draw * 7919 + s * 104729) % inf.PRIME
            g = (h * h + s) % inf.PRIME
            g = (g * g + draw * 48271 + 11) % inf.PRIME
            w.append(sum((g * 69621 + h) % inf.PRIME >= v for v in inf.poisson_limits()))
        w = np.array(w)
        one, other = scores(w, a), scores(w, b)
        for k in deltas:
            deltas[k].append(other[k] - one[k])
    got = {r.stat: r for r in inf.row_paired_bootstrap(df, "slot", "y", "a", "b", draws=draws).collect()}
    for k, v in deltas.items():
        whole = scores(np.ones(len(y)), b)[k] - scores(np.ones(len(y)), a)[k]
        assert (got[k].delta, got[k].lo, got[k].hi) == pytest.approx((whole, np.quantile(v, 0.025), np.quantile(v, 0.975)), rel=1e-9)


def test_row_bootstrap_spreads_as_theory_says(spark):
    """The bounds of a mean difference are as wide as its standard error asks, so draws are not alike."""
    rows = paired(3000, 5)
    df = spark.createDataFrame(rows, "slot bigint, y double, a double, b double")
    r = {x.stat: x for x in inf.row_paired_bootstrap(df, "slot", "y", "a", "b", draws=1000).collect()}["mae"]
    d = np.array([abs(y - b) - abs(y - a) for _, y, a, b in rows])
    assert (r.hi - r.lo) / (2 * 1.96 * d.std() / math.sqrt(len(d))) == pytest.approx(1.0, abs=0.1)
    draws = inf._uniform(42, np.arange(4000), np.arange(50)) / inf.PRIME
    assert abs(draws.mean() - 0.5) < 0.005 and abs(np.corrcoef(draws[:-1].ravel(), draws[1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(draws[:, :-1].ravel(), draws[:, 1:].ravel())[0, 1]) < 0.01
    plan = inf.row_paired_bootstrap(df, "slot", "y", "a", "b")._jdf.queryExecution().toString()
    assert "Join" not in plan
    assert inf.row_paired_bootstrap(df.limit(0), "slot", "y", "a", "b").where("delta is not null").count() == 0


def test_least_squares_equals_numpy(spark):
    rnd = np.random.default_rng(8)
    n = 400
    c = rnd.integers(12, size=n)
    x = rnd.normal(size=(n, 3)) * [1, 100, 0.01] + [0, 1e4, 5]
    y = 3 + x @ [2, -0.5, 40] + rnd.normal(size=12)[c] + rnd.normal(size=n)
    rows = [(int(c[i]), *map(float, x[i]), float(y[i])) for i in range(n)] + [(1, None, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0, None)]
    got = inf.cluster_robust_ols(spark.createDataFrame(rows, "c int, a double, b double, d double, y double").repartition(4), "c", ["a", "b", "d"], "y").collect()
    m = np.column_stack([np.ones(n), x])
    inverse = np.linalg.inv(m.T @ m)
    beta = inverse @ m.T @ y
    u = y - m @ beta
    meat = sum(np.outer(s := m[c == k].T @ u[c == k], s) for k in range(12))
    errors = np.sqrt(np.diag(inverse @ meat @ inverse) * 12 / 11 * (n - 1) / (n - 4))
    assert [r.term for r in got] == ["intercept", "a", "b", "d"]
    assert [r.coefficient for r in got] == pytest.approx(list(beta), rel=1e-6)
    assert [r.std_error for r in got] == pytest.approx(list(errors), rel=1e-6)
    assert [r.hi - r.lo for r in got] == pytest.approx(list(2 * 2.200985160082949 * errors), rel=1e-6)  # t of 11 degrees
    assert got[0].r_squared == pytest.approx(1 - (u @ u) / ((y - y.mean()) ** 2).sum()) and got[0].clusters == 12 and got[0].n == n and got[1].p_value < 1e-6


def test_least_squares_of_little(spark):
    schema = "c int, a double, b double, y double"
    assert inf.cluster_robust_ols(spark.createDataFrame([], schema), "c", ["a", "b"], "y").count() == 0
    few = inf.cluster_robust_ols(spark.createDataFrame([(i % 3, float(i), 2.0 * i, 3.0 * i) for i in range(9)], schema), "c", ["a", "b"], "y").collect()
    assert [r.supported for r in few] == [False] * 3 and few[1].std_error is None
    assert few[1].coefficient + 2 * few[2].coefficient == pytest.approx(3.0)  # collinear: they share the effect


def test_student_points():
    for df, t in ((1, 12.706204736), (5, 2.5705818356), (29, 2.0452296421), (1000, 1.9623390808)):
        assert special.student_point(df) == pytest.approx(t, rel=1e-8)


def arm(spark, losses, shift=0.0):
    return spark.createDataFrame([(i, i % 8, float(v) + shift) for i, v in enumerate(losses)], "id int, block int, loss double")


def test_two_arms_get_a_verdict(spark):
    rnd = np.random.default_rng(1)
    losses = rnd.normal(size=160) + 5
    a, same = arm(spark, losses), arm(spark, losses + rnd.normal(size=160) * 0.5)
    worse = arm(spark, losses + rnd.normal(size=160) * 0.1, 1.0)
    assert inf.two_arm_verdict(a, worse, ["id"], "loss", "block").first().verdict == "a"
    assert inf.two_arm_verdict(worse, a, ["id"], "loss", "block").first().verdict == "b"
    tie = inf.two_arm_verdict(a, a.withColumn("loss", F.col("loss") + F.when(F.col("block") % 2 == 0, 0.5).otherwise(-0.5)), ["id"], "loss", "block").first()
    assert tie.verdict == "tie" and (tie.rows, tie.blocks) == (160, 8)
    assert inf.two_arm_verdict(a, same, ["id"], "loss", "block").first().rows == 160


@pytest.mark.parametrize("other", ["id > 0", "id < 500", "true"])
def test_arms_that_do_not_match_fail(spark, other):
    a = arm(spark, range(50))
    b = a.where(other) if other == "id > 0" else a.union(a.where("id = 3")) if other == "true" else a.union(a.where("id = 3").withColumn("id", F.lit(99)))
    with pytest.raises(Exception, match="gate matched arms: unmatched = 1"):
        inf.two_arm_verdict(a, b, ["id"], "loss", "block").collect()


def test_gates_stop_what_depends_on_them(spark, tmp_path):
    good = spark.createDataFrame([(float(i), float(i) * 2 + (i % 3) / 10) for i in range(40)], "x double, y double")
    assert audits.agreement_gate(good, "x", "y").count() == 40 and audits.agreement_gate(good.limit(0), "x", "y").count() == 0
    bad = good.withColumn("y", F.col("x") % 7)
    with pytest.raises(Exception, match="gate agreement: n = 40, r = "):
        audits.agreement_gate(bad, "x", "y").write.parquet(str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*.parquet"))
    panel = spark.createDataFrame([("train", 1.0), ("val", 2.0), ("test", 3.0)], "part string, fallback double")
    held, index = audits.method_gate(panel, "part", ["train", "val", "test"], "preferred", "fallback", [])
    assert index == "fallback" and held.count() == 3
    with pytest.raises(Exception, match="gate split: train = 1, val = 0"):
        audits.method_gate(panel.where("part <> 'val'"), "part", ["train", "val"], "preferred", "fallback", [])[0].collect()
    with pytest.raises(ValueError, match="index.none"):
        audits.method_gate(panel, "part", ["train"], "absent", "none", [])
