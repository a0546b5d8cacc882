"""Quantile boosting against a plain numpy form, by its loss, and at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import boosting, models


def data(n, seed):
    rnd = np.random.default_rng(seed)
    x, z = rnd.normal(size=n), rnd.integers(5, size=n).astype(float)
    y = 2 * np.abs(x) + z + rnd.normal(size=n) * (0.3 + np.abs(x))
    return x, z, y


def frame(spark, n, seed, missing=True):
    x, z, y = data(n, seed)
    rows = [(i, float(a) if not missing or i % 17 else None, float(b) if not missing or i % 23 else float("nan"), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))]
    return rows, spark.createDataFrame(rows, "id int, x double, z double, y double").repartition(3)


def quantile(v, level):
    v = np.sort(v)
    return v[max(0, int(np.ceil(level * len(v) - 1e-9)) - 1)]


def plain(rows, level, rounds, depth, rate, bins, least):
    """Boosted trees of one level, node by node over whole arrays."""
    y = np.array([r[3] for r in rows])
    features = [np.array([np.nan if r[k] is None else r[k] for r in rows]) for k in (1, 2)]
    edges = [sorted({quantile(x[~np.isnan(x)], i / bins) for i in range(1, bins)}) for x in features]
    binned = [np.array([0 if np.isnan(v) else 1 + sum(e < v for e in es) for v in x]) for x, es in zip(features, edges, strict=True)]
    f = np.full(len(y), quantile(y, level))

    def grow(members, left):
        low = y < f
        best = (1e-9, None)
        for j, b in enumerate(binned if left else []):
            for cut in range(2 + max(map(len, edges))):
                go = members & (b <= cut)
                stay = members & (b > cut)
                if go.sum() >= least and stay.sum() >= least:
                    score = lambda m: (level * m.sum() - (low & m).sum()) ** 2 / m.sum()
                    gain = score(go) + score(stay) - score(members)
                    if gain > best[0] + 1e-12:
                        best = (gain, (go, stay))
        if best[1] is None:
            moved[members] = rate * quantile((y - f)[members], level)
        else:
            for part in best[1]:
                grow(part, left - 1)

    for _ in range(rounds):
        moved = np.zeros(len(y))
        grow(np.ones(len(y), bool), depth)
        f = f + moved
    return f


def test_boosting_equals_numpy(spark):
    rows, df = frame(spark, 500, 1)
    options = {"rounds": 10, "depth": 2, "rate": 0.3, "bins": 8, "least": 15}
    model = boosting.fit_quantiles(df, ["x", "z"], "y", [0.05, 0.5, 0.95], **options)
    got = {r.id: (r.a, r.b, r.c) for r in model.transform(df, ["a", "b", "c"]).collect()}
    for k, level in enumerate((0.05, 0.5, 0.95)):
        want = plain(rows, level, *options.values())
        assert [got[r[0]][k] for r in rows] == pytest.approx(list(want), abs=1e-9)


def test_boosting_covers_and_beats_residual_quantiles(spark):
    _, df = frame(spark, 6000, 2, missing=False)
    fit, dev, test = F.col("id") < 3000, (F.col("id") >= 3000) & (F.col("id") < 4000), F.col("id") >= 4000
    own = boosting.quantile_intervals(df, ["x", "z"], "y", fit, rounds=30, rate=0.2).where(test)
    other = models.tree_intervals(df, ["x", "z"], "y", fit, dev).where(test)
    y = F.col("y")
    loss = lambda d: d.agg((F.avg(boosting.pinball(y, F.col("lo"), 0.05)) + F.avg(boosting.pinball(y, F.col("hi"), 0.95))).alias("l")).first().l
    assert loss(own) < loss(other)
    share = own.agg(F.avg(((y >= F.col("lo")) & (y <= F.col("hi"))).cast("int")).alias("s")).first().s
    assert abs(share - 0.9) < 0.03


def test_boosting_at_the_edges(spark):
    none = spark.createDataFrame([], "x double, y double")
    assert boosting.quantile_intervals(none, ["x"], "y", F.lit(True)).count() == 0
    same = spark.createDataFrame([(1.0, 3.0, "k")] * 50 + [(None, None, "k")], "x double, y double, lo_name string")
    out = boosting.quantile_intervals(same, ["x"], "y", F.lit(True), rounds=2).collect()
    assert len(out) == 51 and {(r.lo, r.pred, r.hi) for r in out} == {(3.0, 3.0, 3.0)}
