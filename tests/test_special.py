"""Distribution functions against closed forms and exact sums, deep into their tails."""

import math
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from loomspan.functions import special
from loomspan.operators import inference as inf

getcontext().prec = 450


def values(spark, expr, rows):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, a double, b double").repartition(1)
    return [r[0] for r in df.orderBy("i").select(expr(F.col("a"), F.col("b"))).collect()]


def close(got, want, tolerance=1e-9):
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=tolerance, abs=1e-307), (g, w)


def poisson_tail(a, x):
    """The upper gamma function of a whole shape: a sum of Poisson chances, exactly."""
    x, term, total = Decimal(x), Decimal(1), Decimal(1)
    for k in range(1, a):
        term *= x / k
        total += term
    return float(total * (-x).exp())


def test_normal_tails(spark):
    z = [0.0, 1e-9, 0.5, 1.0, 1.7, 2.0, 5.0, 8.0, -8.0, 10.0, 20.0, 37.0, 38.5, 39.0, 40.0, 100.0, 1e5, 1e200, math.inf]
    got = values(spark, lambda a, b: special.normal_two_sided(a), [(x, 0) for x in z])
    close(got, [math.erfc(abs(x) / math.sqrt(2)) for x in z])
    assert got[-3:] == [0.0, 0.0, 0.0]
    close(values(spark, lambda a, b: special.normal_cdf(a), [(-6, 0), (-1, 0), (0, 0), (2, 0)]), [9.865876450376946e-10, 0.15865525393145707, 0.5, 0.9772498680518208])


def test_gamma_tails(spark):
    cases = [(1, 0.1), (1, 700), (2, 3), (17, 750), (17, 4), (39, 39), (40, 39), (40, 40), (40, 80), (100, 99), (100, 300), (1000, 900), (1000, 1000), (1000, 1500), (20000, 20000), (20000, 21500), (20000, 19000)]
    close(values(spark, special.upper_gamma, cases), [poisson_tail(a, x) for a, x in cases])
    low = values(spark, special.lower_gamma, [(2, 1e-3), (2, 500), (2, 760), (0.5, 1e-12), (300, 200), (5, -1), (5, 0)])
    close(low, [1 - math.exp(-1e-3) * (1 + 1e-3), 1.0, 1.0, math.erf(1e-6), low[4], 0.0, 0.0], 1e-8)
    assert 0 < low[4] < 1e-9
    close(values(spark, special.chi2_sf, [(1500, 1), (1521, 3), (1500, 34), (3.841458820694124, 1), (1e6, 2)]), [math.erfc(math.sqrt(750)), math.erfc(math.sqrt(760.5)) + math.sqrt(2 * 1521 / math.pi) * math.exp(-760.5), poisson_tail(17, 750), 0.05, 0.0])


def student(t, df):
    """Even degrees: an algebraic sum, exactly."""
    t, df = Decimal(t), int(df)
    sine, cos2, term, total = t / (Decimal(df) + t * t).sqrt(), Decimal(df) / (Decimal(df) + t * t), Decimal(1), Decimal(1)
    for k in range(1, df // 2):
        term *= cos2 * (2 * k - 1) / (2 * k)
        total += term
    return float(1 - sine * total)


def test_student_tails(spark):
    even = [(t, df) for df in (2, 4, 10, 30, 200, 100_000) for t in (0.01, 0.5, 2, 5, 10)] + [(1e4, 2), (1e6, 4), (1e4, 30), (40, 10000)]
    close(values(spark, special.student_two_sided, even), [student(t, df) for t, df in even])
    odd = [(0, 1), (1, 1), (1e8, 1), (-2.570581835636314, 5), (2.0452296421327034, 29), (1.959966, 1e7), (1e4, 1e7), (math.inf, 3)]
    got = values(spark, special.student_two_sided, odd)
    close(got[:5], [1.0, 0.5, 2 / math.pi * math.atan(1e-8), 0.05, 0.05])
    assert got[5] == pytest.approx(0.05, abs=1e-6) and got[6:] == [0.0, 0.0]


def test_binomial_tails(spark):
    cases = [(0, 0), (0, 1), (1, 2), (0, 10), (3, 10), (7, 10), (5, 10), (4, 9), (400, 1000), (9000, 20000), (9990, 20000), (0, 1000), (100, 3000)]
    want = []
    for k, n in cases:
        term, total = 1, 0
        for i in range(min(k, n - k) + 1):
            total += term
            term = term * (n - i) // (i + 1)
        want.append(min(1.0, float(Decimal(2 * total) / Decimal(2) ** n)))
    close(values(spark, special.binomial_two_sided, cases), want)
    many = values(spark, special.binomial_two_sided, [(5e6 - 5000, 1e7), (5e6, 1e7), (0, 1e7)])
    assert many[0] == pytest.approx(math.erfc((10000 - 1) / math.sqrt(1e7) / math.sqrt(2)), rel=1e-3) and many[1:] == [1.0, 0.0]


def test_range_of_normals():
    # 5 % points of the studentised range of unbounded degrees, as published to three decimals
    for k, q in ((2, 2.772), (3, 3.314), (4, 3.633), (5, 3.858), (10, 4.474), (20, 5.012), (100, 6.085)):
        assert special.range_quantile(k) == pytest.approx(q, abs=6e-4)
    assert special.range_quantile(3) / math.sqrt(2) == pytest.approx(2.3437005, abs=1e-7)
    for q in (0.5, 3.0, 12.0, 40.0):  # two variables: their difference is normal
        assert special.range_sf(q, 2) == pytest.approx(math.erfc(q / 2), rel=1e-9)


def test_the_strongest_effects_have_the_smallest_p_values(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, "a").otherwise("b").alias("g"), F.col("id").cast("double").alias("v"))
    r = inf.kruskal(rows, "g", "v").first()
    assert r.h == pytest.approx(4499.25) and 0 <= r.p_value < 1e-300
    pairs = spark.range(4000).select("id", (F.col("id") + 2.0).alias("a"), F.lit(1.0).alias("b"))
    assert inf.signed_rank(pairs, "id", "a", "b").first().p_value == pytest.approx(math.erfc(2000 * 4001 / 2 / math.sqrt(4000 * 4001 * 8001 / 24) / math.sqrt(2)), rel=1e-6)
    r = inf.paired_test(pairs, "id", "a", "b").first()
    assert r.p_value < 1e-300 and r.sign_p == pytest.approx(0.0, abs=1e-300)
    methods = spark.createDataFrame([(f"m{i}", float(i), 50) for i in range(14)], "method string, mean_rank double, blocks int")
    assert inf.nemenyi(methods, "method").where("significant").count() == sum(j - i > special.range_quantile(14) / math.sqrt(2) * math.sqrt(14 * 15 / 300) for i in range(14) for j in range(i + 1, 14))
