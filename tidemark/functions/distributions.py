"""Distribution functions for result rows.

Normal-based figures are plain Columns. Student t, F, chi-square and beta tails
have no built-in counterpart; they run as small vectorised functions over the
handful of rows an aggregate leaves behind.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F

# Published rational approximation of the error function (7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Published rational approximation of the normal quantile.
QUANTILE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
QUANTILE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
QUANTILE_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
QUANTILE_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(c)
    return out


def erf(x: Column) -> Column:
    """Error function, absolute error below 1.5e-7."""
    a = F.abs(x)
    t = 1.0 / (1.0 + ERF_P * a)
    series = _poly(ERF_A[::-1], t) * t
    return F.signum(x) * (1.0 - series * F.exp(-a * a))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / F.lit(math.sqrt(2.0))))


def two_sided_normal(z: Column) -> Column:
    return 1.0 - erf(F.abs(z) / F.lit(math.sqrt(2.0)))


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution, relative error about 1e-9."""

    def tail(q):
        return _poly(QUANTILE_C, q) / _poly((*QUANTILE_D, 1.0), q)

    low = F.sqrt(-2.0 * F.log(p))
    high = F.sqrt(-2.0 * F.log(1.0 - p))
    mid = p - 0.5
    r = mid * mid
    centre = _poly(QUANTILE_A, r) * mid / _poly((*QUANTILE_B, 1.0), r)
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(centre)


def kolmogorov_sf(lam: Column) -> Column:
    """Asymptotic two-sided tail of the Kolmogorov-Smirnov statistic."""
    terms = F.sequence(F.lit(1), F.lit(100))
    total = F.aggregate(
        terms, F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam)
    )
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * total)))


def _kernels():
    """Incomplete beta and gamma (kept inside the function so that executors get them by value).

    Series and fractions run until they converge, about as long as the square root of
    the parameters. The factors in front are written as densities by deviance and
    Stirling error, so that large parameters don't cancel.
    """

    def stirling_error(n):
        """log n! less Stirling's formula."""
        if n < 16:
            return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
        m = n * n
        return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * m)) / m) / m) / m) / n

    def deviance(x, mean):
        """x log(x / mean) + mean - x, without loss where x is near the mean."""
        if abs(x - mean) < 0.1 * (x + mean):
            v = (x - mean) / (x + mean)
            total, term, k = (x - mean) * v, 2 * x * v, 1
            while True:
                term *= v * v
                k += 2
                more = total + term / k
                if more == total:
                    return total
                total = more
        return x * math.log(x / mean) + mean - x

    def beta_front(a, b, x, y):
        """x^a y^b / B(a, b) with y = 1 - x."""
        n = a + b
        logs = stirling_error(n) - stirling_error(a) - stirling_error(b) - deviance(a, n * x) - deviance(b, n * y)
        return math.exp(logs) * math.sqrt(a * b / (2 * math.pi * n))

    def betainc(a, b, x, y=None):
        y = 1 - x if y is None else y
        if x <= 0:
            return 0.0
        if y <= 0:
            return 1.0
        # one parameter far larger than the other: the fraction would cancel, the gamma limit is exact to 1e-10
        if a * a > 1e10 * (1 + b) ** 3:
            return gammainc_upper(b, -(a + (b - 1) / 2) * math.log1p(-y))
        if b * b > 1e10 * (1 + a) ** 3:
            return 1.0 - gammainc_upper(a, -(b + (a - 1) / 2) * math.log1p(-x))
        if x > (a + 1) / (a + b + 2):
            return 1.0 - betainc(b, a, y, x)
        c, d, f, m = 1.0, 0.0, 1.0, 0
        while True:  # two steps of the continued fraction at a time
            f_old = f
            for num in (
                (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))) if m else 1.0,
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1.0 + num / c
                c = c if abs(c) > 1e-300 else 1e-300
                f *= c * d
            m += 1
            if abs(f - f_old) <= 1e-15 * abs(f):
                return beta_front(a, b, x, y) / a * (f - 1.0)
            if f != f:
                raise ArithmeticError(f"incomplete beta of {a}, {b} at {x}")

    def gammainc_upper(s, x):
        if x <= 0:
            return 1.0
        density = math.exp(-stirling_error(s) - deviance(s, x)) / math.sqrt(2 * math.pi * s)  # x^s e^-x / s!
        if x < s + 1:
            term = total = 1.0
            n = 0
            while term > total * 1e-17:
                n += 1
                term *= x / (s + n)
                total += term
            return 1.0 - total * density
        b = x + 1 - s
        c, d = 1e300, 1.0 / b
        h, n = d, 0
        while True:
            n += 1
            an = -n * (n - s)
            b += 2
            d = an * d + b
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = b + an / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                return density * s * h
            if h != h:
                raise ArithmeticError(f"incomplete gamma of {s} at {x}")

    def solve(fn, lo, hi):
        """Root of a growing function; ``hi`` is doubled until it lies beyond the root."""
        while hi > 1 and fn(hi) < 0:
            hi *= 2
        for _ in range(200):
            mid = (lo + hi) / 2
            if fn(mid) < 0:
                lo = mid
            else:
                hi = mid
        return (lo + hi) / 2

    return betainc, gammainc_upper, solve


def _row_function(make, *cols: Column) -> Column:
    def evaluate(*series: pd.Series) -> pd.Series:
        fn = make()
        rows = zip(*series, strict=True)
        return pd.Series([None if any(pd.isna(v) for v in r) else fn(*map(float, r)) for r in rows], dtype="float64")

    if len(cols) == 1:
        def run(a: pd.Series) -> pd.Series:
            return evaluate(a)
    elif len(cols) == 2:
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return evaluate(a, b)
    else:
        def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return evaluate(a, b, c)
    return F.pandas_udf(run, "double")(*[c.cast("double") for c in cols])


def t_two_sided(t: Column, df: Column) -> Column:
    kernels = _kernels

    def make():
        betainc, _, _ = kernels()
        return lambda x, v: betainc(v / 2, 0.5, v / (v + x * x), x * x / (v + x * x))

    return _row_function(make, t, df)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    kernels = _kernels

    def make():
        betainc, _, _ = kernels()
        return lambda x, a, b: betainc(b / 2, a / 2, b / (b + a * x), a * x / (b + a * x))

    return _row_function(make, f, d1, d2)


def chi2_tail(x: Column, df: Column) -> Column:
    kernels = _kernels

    def make():
        _, gammainc_upper, _ = kernels()
        return lambda v, k: gammainc_upper(k / 2, v / 2)

    return _row_function(make, x, df)


def t_quantile(p: Column, df: Column) -> Column:
    """Upper quantile of Student t for p above one half."""
    kernels = _kernels

    def make():
        betainc, _, solve = kernels()
        tail = lambda x, v: betainc(v / 2, 0.5, v / (v + x * x), x * x / (v + x * x)) / 2
        return lambda q, v: solve(lambda x: (1 - q) - tail(x, v), 0.0, 16.0)

    return _row_function(make, p, df)


def beta_quantile(p: Column, a: Column, b: Column) -> Column:
    kernels = _kernels

    def make():
        betainc, _, solve = kernels()
        return lambda q, s, t: solve(lambda x: betainc(s, t, x) - q, 0.0, 1.0)

    return _row_function(make, p, a, b)
