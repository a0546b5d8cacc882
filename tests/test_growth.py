"""Steps that must not grow faster than their input, or give other rows when they are made anew."""

import datetime
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import inference as inf
from loomspan.operators import intervals, joins, ordering, splits
from loomspan.operators import timeseries as ts
from loomspan.plans import registry

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("piece", [1 << 19, 7])
def test_resampled_clusters_equal_a_loop(spark, monkeypatch, piece):
    """No row a pick is made: a plan of draws times clusters was taken for small and broadcast whole."""
    monkeypatch.setattr(inf, "CLUSTER_PIECE", piece)
    rnd = random.Random(1)
    rows = [(c, rnd.randrange(100), None if c == 3 else float("inf") if c == 5 else rnd.random()) for c in range(23) for _ in range(3)]
    df = spark.createDataFrame(rows, "c int, n int, v double")
    out = inf.resample_clusters(df, "c", {"n": F.sum("n"), "v": F.sum("v")}, 30)
    assert "Generate explode(sequence(0, (k" not in plan_of(out)
    got = {r.draw: (r.n, r.v) for r in out.collect()}
    sums = [(sum(n for c, n, _ in rows if c == k), [v for c, _, v in rows if c == k and v is not None]) for k in range(23)]
    for d in range(30):
        i = [(((((42 + d * 7919 + s * 104729) % inf.PRIME) * 48271 + 11) % inf.PRIME) * 69621 + 7) % inf.PRIME % 23 for s in range(23)]
        n, v = got[d]
        assert n == sum(sums[k][0] for k in i) and v == pytest.approx(sum(sum(sums[k][1]) for k in i))


def unsteady():
    """A column that differs each time it is made, as a sum of doubles may in its last bit."""
    return F.udf(lambda: random.random(), "double").asNondeterministic()()


def test_checked_intervals_are_made_once(spark):
    rows = spark.range(50).select(F.lit("a").alias("m"), "id", unsteady().alias("lo")).withColumn("hi", F.col("lo") + 1)
    assert [(r.rows, r.differs) for r in intervals.calibration_checks(rows, "m", ["id"]).collect()] == [(50, 0)]


def test_narrow_sums_are_not_off_by_what_came_before(spark):
    values = [176.89, 490.49, 480.95, 80.59, 226.2, 260.17, 113.63]
    rows = [("a", datetime.date(2024, 1, d), v) for d, v in enumerate(values, 1)]
    got = ts.strict_rolling_sum(spark.createDataFrame(rows, "entity string, day date, value double"), 3).orderBy("day").collect()
    assert got[-1].rolled == 600.0


def test_kruskal_ranks_each_value_it_made(spark):
    rows = spark.range(60).select((F.col("id") % 3).alias("g"), unsteady().alias("v"))
    assert inf.kruskal(rows, "g", "v").first().h is not None


def test_crosswalk_is_counted_without_pairs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c")], "id int, k string")
    walk = spark.createDataFrame([("a", 7), ("a", 8), ("b", None), ("d", 9)], "k string, t int")
    want = joins.crosswalk(df, walk, ["k"], "t").groupBy("id", "status").count().collect()
    assert sorted(joins.crosswalk_counts(df, walk, ["k"], "t").select("id", "status", "fan").collect()) == sorted(want)
    many = spark.range(30000).select(F.col("id"), F.lit("k").alias("k"))
    spread = joins.crosswalk_counts(many, many.withColumnRenamed("id", "t"), ["k"], "t")
    assert spread.count() == 30000 and spread.agg(F.sum("fan")).first()[0] == 30000**2


def test_lags_of_all_modes_take_one_join(spark):
    assert plan_of(registry.QUERIES["split_aware_lags"](spark, SF)).count("Join LeftOuter") == 1
    panel = spark.createDataFrame([(1, 1, 5.0, "TRAIN", "VAL"), (1, 2, 6.0, "TEST", "VAL"), (1, 4, 7.0, "TEST", "VAL")], "e int, o int, v double, p string, q string")
    got = splits.scoped_lags(panel, 1, "e", "o", "v", {"x": ("p", splits.OWN), "y": ("q", splits.OWN)}).orderBy("o").collect()
    assert [(r.lag_x, r.lag_y) for r in got] == [(None, None), (None, 5.0), (None, None)]


def test_repeated_keys_are_counted_without_windows(spark):
    assert "Window" not in plan_of(registry.QUERIES["repeated_key_flags"](spark, SF))


def test_nearest_on_a_line_make_no_pairs_of_a_place(spark):
    rnd = random.Random(3)
    sites = [(i, rnd.choice([0.0, 0.1, 0.2, 0.3, 5.0, 5.4, 99.0]) if i % 4 else rnd.random() * 8) for i in range(90)]
    want = set()
    for i, x in sites:
        near = sorted((abs(x - z), j) for j, z in sites if j != i and abs(x - z) <= 2)[:3]
        want |= {(i, j, k, d) for k, (d, j) in enumerate(near, 1)}
    held = spark.createDataFrame([*sites, (1000, None)], "site bigint, x double")
    assert {tuple(r) for r in joins.nearest_on_line(held, 2, 3).select("site", "neighbour", "rank", "d").collect()} == want
    close = spark.range(60000).select(F.col("id").alias("site"), F.lit(1.0).alias("x"))
    assert joins.nearest_on_line(close, 2, 3).count() == 180000


def test_points_at_a_place_are_ranked_once_and_spread_over_tasks(spark, monkeypatch):
    rnd = random.Random(4)
    spots = [(rnd.randrange(40) / 2, rnd.randrange(40) / 2) for _ in range(12)]
    points = [(i, *spots[i % 12]) for i in range(240)] + [(7, 3.0, 3.0), (7, 3.0, 3.0), (900, 500.0, 1.0), (901, None, 1.0)]
    sites = [(1000 + i, rnd.randrange(40) / 2, rnd.randrange(40) / 2) for i in range(50)] + [(1000, 4.0, 4.0)]
    rows = {}
    for p, x, y in points:
        if x is not None:
            rows.setdefault(p, []).extend((math.hypot(x - u, y - v), s) for s, u, v in sites)
    want = Counter((p, s, round(d, 9), k) for p, met in rows.items() for k, (d, s) in enumerate(sorted(met), 1) if d <= 5 or k == 1)
    want[(901, None, None, None)] = 1
    monkeypatch.setattr(joins, "PAIRS", 97)
    p, s = spark.createDataFrame(points, "point int, x double, y double"), spark.createDataFrame(sites, "site int, x double, y double")
    got = joins.within_or_nearest(p, s, 5.0, 6.0)
    assert Counter((r.point, r.site, r.distance and round(r.distance, 9), r["rank"]) for r in got.collect()) == want
    ranked = []
    monkeypatch.setattr(joins, "_spread", lambda few, many, key: ranked.append(many.count()) or few.join(many, key).drop(key))
    close = spark.range(3000).select(F.col("id").alias("point"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    assert joins.within_or_nearest(close, s, 40.0, 40.0).count() == 3000 * 51 and ranked == [51]


def test_row_draws_without_division_equal_the_formula():
    slot, draw = np.array([0, 1, -5, 2**40 + 3, 2**31 - 2, 2**31 - 1, *range(900, 990)]), np.arange(2000)
    s, p = slot[:, None] % inf.PRIME, inf.PRIME
    h = (42 + draw * 7919 + s * 104729) % p
    g = ((h * h + s) % p * ((h * h + s) % p) + draw * 48271 + 11) % p
    got = inf._uniform(42, slot, draw)
    assert got.dtype == np.int32 and (got == (g * 69621 + h) % p).all()


def test_ranks_look_up_counted_values(spark):
    rows = [("a", 2.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", 7.0), (None, 3.0), (None, 3.0)]
    got = ordering.mean_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "rank").collect()
    assert sorted(map(str, got)) == sorted(f"Row(k={k!r}, v={v}, rank={x})" for (k, v), x in zip(rows, [2.5, 1.0, 2.5, 4.0, 1.0, 1.5, 1.5], strict=True))
    plan = plan_of(registry.QUERIES["rank_correlation"](spark, SF))
    assert "rank(" not in plan


def test_adjusted_p_values_run_over_ranges(spark):
    rnd = random.Random(8)
    rows = [(k, t, round(rnd.random() ** 4, 3)) for k in (None, "x", "y") for t in range(40)]
    df = spark.createDataFrame(rows, "k string, test int, p double")
    got = {(r.k, r.test): (r.holm, r.bh) for r in inf.adjust_p(df, "p", "k").collect()}
    for k in (None, "x", "y"):
        own = sorted((p, t) for q, t, p in rows if q == k)
        holm = np.maximum.accumulate([min(p * (40 - i), 1.0) for i, (p, _) in enumerate(own)])
        bh = np.minimum.accumulate([min(p * 40 / (i + 1), 1.0) for i, (p, _) in reversed(list(enumerate(own)))])[::-1]
        for (_, t), h, b in zip(own, holm, bh, strict=True):
            assert got[(k, t)] == pytest.approx((h, b))
    assert "currentrow$(), unboundedfollowing$()" not in plan_of(inf.adjust_p(df)).lower()
