"""Tail probabilities that Spark has no functions for: normal, Student's t, chi-squared.

For tables of statistics (a row per test). Continued fractions and series of the regularised incomplete beta and gamma
functions, to about twelve digits.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 1000):
        top = -i * (i - a)
        b += 2.0
        d = top * d + b
        c = b + top / c
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def t_tail(t: float, df: float) -> float:
    """P(T > t)."""
    half = 0.5 * incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1.0 - t_tail(mid, df) < p else (low, mid)
    return (low + high) / 2


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _mapped(f, *cols: Column | str) -> Column:
    @F.pandas_udf("double")
    def each(*parts: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*map(float, row)) for row in zip(*parts)], dtype="float64")

    return each(*[F.col(c) if isinstance(c, str) else c for c in cols])


def t_two_sided(t: Column | str, df: Column | str) -> Column:
    return _mapped(lambda x, n: 2.0 * t_tail(abs(x), n), t, df)


def t_upper(t: Column | str, df: Column | str) -> Column:
    return _mapped(t_tail, t, df)


def chi2_upper(x: Column | str, df: Column | str) -> Column:
    return _mapped(lambda v, n: upper_gamma(n / 2.0, v / 2.0), x, df)


def normal_two_sided(z: Column | str) -> Column:
    return _mapped(lambda x: 2.0 * normal_tail(abs(x)), z)


def t_critical(level: float, df: Column | str) -> Column:
    """The two-sided critical value of a confidence level."""
    return _mapped(lambda n: t_quantile(0.5 + level / 2.0, n), df)
