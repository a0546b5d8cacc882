"""Distribution functions as columns of built-in functions, no Python workers.

Tails are computed themselves, not as one less the other side, so that a strong effect gives a small p-value and not 0 by
cancellation or 1 by underflow. The number of steps of each function is fixed: nothing grows with its arguments. Where a
density can be sharp, its tail is an integral from the argument outwards over the width in which it falls by exp(-60).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of series and continued fractions; enough for 15 digits up to LARGE.
STEPS = 64
#: Shapes from which gamma tails are integrals.
LARGE = 40
#: Nodes of the integrals, and the exponent at which an integrand ends.
NODES, FALL = 64, 60.0
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _let(f, *args: Column) -> Column:
    """f(*args) with each argument worked out once, although f uses it many times: the expression stays small."""
    held = F.struct(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(args)])
    return F.transform(F.array(held), lambda s: f(*[s[f"v{i}"] for i in range(len(args))]))[0]


def _stirling(z: Column) -> Column:
    """The remainder of Stirling's formula: ln gamma(z) - (z - 1/2) ln z + z - ln(2 pi) / 2, for z >= 8."""
    w = 1 / (z * z)
    return (F.lit(1 / 12) - w * (F.lit(1 / 360) - w * (F.lit(1 / 1260) - w * (F.lit(1 / 1680) - w / 1188)))) / z


def _rising(x: Column, n: int) -> Column:
    out = x
    for k in range(1, n):
        out = out * (x + k)
    return out


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's formula at x + 8, less the logarithm of the steps up (from 8 on, without them)."""
    at = lambda z: (z - 0.5) * F.ln(z) - z + HALF_LOG_2PI + _stirling(z)
    return _let(lambda x, z: at(z) - F.when(x < 8, F.ln(_rising(x, 8))).otherwise(0.0), x, F.when(x < 8, x + 8).otherwise(x))


def _tail(ratio, slope: Column, bend: Column, end: Column) -> Column:
    """Integral from 0 to `end` of exp(ratio(u)), which falls at least like exp(-slope * u) or a Gaussian of that bend, by Gauss and Legendre."""
    reach = 2 * FALL / F.greatest(slope + F.sqrt(slope * slope + 2 * FALL * bend), F.lit(1e-300))
    x, w = np.polynomial.legendre.leggauss(NODES)
    nodes = F.array(*[F.struct(F.lit(float((1 + a) / 2)).alias("x"), F.lit(float(b / 2)).alias("w")) for a, b in zip(x, w, strict=True)])
    held = F.struct(F.least(reach, end).alias("u"), F.lit(0.0).alias("s"))  # the reach is worked out once
    return F.aggregate(nodes, held, lambda s, n: F.struct(s["u"].alias("u"), (s["s"] + n["w"] * F.exp(ratio(s["u"] * n["x"]))).alias("s")), lambda s: s["s"] * s["u"])


def _density(a: Column, x: Column) -> Column:
    """x times the density of a standard gamma variable of shape a at x."""
    small = F.exp(a * F.ln(x) - x - log_gamma(a))
    # for large shapes the terms above cancel: the distance from the shape is taken first
    large = F.exp(-a * ((x - a) / a - F.log1p((x - a) / a)) - _stirling(a)) * F.sqrt(a / (2 * math.pi))
    return F.when(a < LARGE, small).otherwise(large)


def _series(a: Column, x: Column) -> Column:
    total = F.lit(1.0)
    for k in range(STEPS, 0, -1):
        total = 1 + x / (a + k) * total
    return total / a


def _fraction(a: Column, x: Column) -> Column:
    f = x + (2 * STEPS + 1) - a
    for k in range(STEPS, 0, -1):
        f = x + (2 * k - 1) - a - k * (k - a) / f
    return 1 / f


def _above(a: Column, x: Column) -> Column:
    """Integral of a large-shape gamma density from x up, over that density times x; x is not below the mode."""
    return _tail(lambda u: (a - 1) * F.log1p(u / x) - u, 1 - (a - 1) / x, (a - 1) / (x * x) / 4, F.lit(1e300)) / x


def _below(a: Column, x: Column) -> Column:
    """As _above() from x down; x is not above the mode."""
    return _tail(lambda u: (a - 1) * F.log1p(-u / x) + u, (a - 1) / x - 1, (a - 1) / (x * x), x) / x


def _gamma_parts(a: Column, x: Column) -> tuple[Column, Column, Column]:
    """Whether the upper tail is the one to compute, that tail, and the lower one; for 0 < x < 3 a + 2000."""
    upper = F.when(a < LARGE, x >= a + 1).otherwise(x >= a - 1)
    d = _density(a, x)
    return upper, d * F.when(a < LARGE, _fraction(a, x)).otherwise(_above(a, x)), d * F.when(a < LARGE, _series(a, x)).otherwise(_below(a, x))


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function of shape a > 0; 1 for x <= 0, and 0 where it is below the smallest number."""

    def work(a: Column, x: Column) -> Column:
        upper, high, low = _gamma_parts(a, x)
        return F.when(a.isNull() | x.isNull() | F.isnan(x), None).when(x <= 0, 1.0).when(x >= 3 * a + 2000, 0.0).when(upper, high).otherwise(1 - low)

    return _let(work, a, x)


def lower_gamma(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function of shape a > 0; 0 for x <= 0."""

    def work(a: Column, x: Column) -> Column:
        upper, high, low = _gamma_parts(a, x)
        return F.when(a.isNull() | x.isNull() | F.isnan(x), None).when(x <= 0, 0.0).when(x >= 3 * a + 2000, 1.0).when(upper, 1 - high).otherwise(low)

    return _let(work, a, x)


def chi2_sf(x: Column, df: Column) -> Column:
    """Probability that a chi-squared variable of df degrees exceeds x."""
    return upper_gamma(df / 2, x / 2)


def normal_two_sided(z: Column) -> Column:
    """Probability that a standard normal variable is farther from 0 than z."""
    return upper_gamma(F.lit(0.5), z * z / 2)


def normal_cdf(z: Column) -> Column:
    """Distribution function of a standard normal variable."""
    return _let(lambda z, both: F.when(z < 0, both / 2).otherwise(1 - both / 2), z, normal_two_sided(z))


def _gamma_step(z: Column) -> Column:
    """gamma(z + 1/2) / gamma(z) / sqrt(z + 8), from the ratio's series at z + 8."""
    y = z + 8
    w = 1 / y
    series = F.exp(-w / 8 + w * w * w * (F.lit(1 / 192) - w * w * (F.lit(1 / 640) - w * w * 17 / 14336)))
    return series * _rising(z, 8) / _rising(z + 0.5, 8)


def student_two_sided(t: Column, df: Column) -> Column:
    """Probability that Student's t of df degrees, a whole number, is farther from 0 than t.

    In the angle psi = atan(sqrt(df) / t), the density is sin(psi) ** (df - 1) up to a constant; its tail starts at 0.
    """

    def work(t: Column, df: Column, psi: Column) -> Column:
        power, sine = df - 1, F.sin(psi)
        inside = _tail(lambda u: power * F.ln(F.sin(psi - u) / sine), power * F.cos(psi) / sine, power / (sine * sine), psi)
        constant = _let(lambda z: _gamma_step(z) * F.sqrt(z + 8), df / 2) / math.sqrt(math.pi)
        p = 2 * constant * F.exp(-power / 2 * F.log1p(t * t / df)) * inside
        return F.when(t.isNull() | df.isNull() | (df < 1), None).when(t > 1e150, 0.0).otherwise(F.least(p, F.lit(1.0)))

    return _let(work, F.abs(t), df, F.atan2(F.sqrt(df.cast("double")), F.abs(t)))


def _stirling_of_factorial(n: Column) -> Column:
    """ln n! less Stirling's (n + 1/2) ln n - n + ln(2 pi) / 2, for n >= 1."""
    return _let(lambda n: F.when(n < 8, log_gamma(n + 1) - (n + 0.5) * F.ln(n) + n - HALF_LOG_2PI).otherwise(_stirling(n)), n)


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Two-sided p-value of k successes in n fair trials, 1 for no trials.

    Twice the chance of at most low = min(k, n - k) successes, which is an integral of t ** (n - low - 1) * (1 - t) ** low
    from 1/2 down.
    """

    def work(n: Column, low: Column, high: Column) -> Column:
        inside = _tail(lambda u: (high - 1) * F.log1p(-2 * u) + low * F.log1p(2 * u), 2 * (n - 2 * low - 1), 4 * (n - 1), F.lit(0.5))
        apart = _let(lambda d: ((1 + d) * F.log1p(d) + (1 - d) * F.log1p(-d)) / 2, (n - 2 * low) / n)
        chance = F.when(low == 0, F.exp(-n * math.log(2))).otherwise(
            F.exp(_stirling_of_factorial(n) - _stirling_of_factorial(low) - _stirling_of_factorial(high) - n * apart) * F.sqrt(n / (2 * math.pi * low * high))
        )
        return F.when(n.isNull() | low.isNull(), None).when((n == 0) | (2 * low >= n - 1), 1.0).otherwise(F.least(2 * 2 * high * chance * inside, F.lit(1.0)))

    return _let(work, n, F.least(k, n - k), F.greatest(k, n - k))


def kolmogorov_sf(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p-value of the two-sample distance d."""
    x = d * F.sqrt(n * m / (n + m))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))


def range_sf(q: float, k: int) -> float:
    """Probability that the range of k standard normal variables exceeds q (the studentised range of unbounded degrees).

    The density of the least variable times the chance that not all others lie within q above it, integrated over it.
    """
    if k < 2 or q <= 0:
        return 1.0
    x, w = np.polynomial.legendre.leggauss(256)
    low, high = -max(9.0, q / 2 + 9), 9.0
    z = low + (high - low) * (x + 1) / 2
    above = np.array([math.erfc(v / math.sqrt(2)) / 2 for v in z])
    out = np.array([math.erfc((v + q) / math.sqrt(2)) / 2 for v in z])
    share = np.minimum(out / np.maximum(above, 1e-300), 1 - 1e-16)
    inside = k * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * above ** (k - 1) * -np.expm1((k - 1) * np.log1p(-share))
    return float(min(1.0, (inside * w).sum() * (high - low) / 2))


def range_quantile(k: int, alpha: float = 0.05) -> float:
    """The range that k standard normal variables exceed with probability alpha."""
    low, high = 0.0, 100.0
    while high - low > 1e-12 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if range_sf(middle, k) > alpha else (low, middle)
    return (low + high) / 2


def student_point(df: int, alpha: float = 0.05) -> float:
    """The t that Student's variable of df degrees is farther from 0 than with probability alpha."""
    x, w = np.polynomial.legendre.leggauss(256)
    constant = 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)

    def tail(t: float) -> float:
        psi = math.atan2(math.sqrt(df), t)
        return constant * float((np.sin(psi * (x + 1) / 2) ** (df - 1) * w).sum() * psi / 2)

    low, high = 0.0, 1e8
    while high - low > 1e-13 * high:
        middle = math.sqrt(low * high) if low > 1 else (low + high) / 2
        low, high = (middle, high) if tail(middle) > alpha else (low, middle)
    return (low + high) / 2
