"""Probabilities as Arrow UDFs: the normal distribution in NumPy for any table, the other tails over small, aggregated ones."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _each(fn, *cols: pd.Series) -> pd.Series:
    def one(*xs):
        if any(x is None or x != x for x in xs):
            return None
        return fn(*map(float, xs))

    return pd.Series([one(*xs) for xs in zip(*cols)], dtype="float64")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def beta_regular(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(s, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while term > total * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1.0 - s
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 1000):
        num = -i * (i - s)
        b += 2.0
        d = num * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + num / c
        c = c if abs(c) > _TINY else _TINY
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_regular(df / 2.0, 0.5, df / (df + t * t))


def chi2_1_from_p(p: float) -> float:
    return NormalDist().inv_cdf(p / 2.0) ** 2


@F.pandas_udf(T.DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def _chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _each(lambda v, k: gamma_upper(k / 2.0, v / 2.0), x, dof)


@F.pandas_udf(T.DoubleType())
def _chi2_1_upper(p: pd.Series) -> pd.Series:
    return _each(lambda v: chi2_1_from_p(v) if 0.0 < v < 1.0 else np.nan, p)


def _erfc(x: Column) -> Column:
    """Complement of the error function of x >= 0: the series with positive terms below 2.5, the continued fraction above."""
    y = 2.0 * x * x
    series = F.aggregate(F.sequence(F.lit(90), F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, k: 1.0 + y / (2.0 * k + 1.0) * s)
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda f, k: x + k / 2.0 / f)
    bell = F.exp(-x * x)
    return F.when(x < 2.5, 1.0 - 2.0 / math.sqrt(math.pi) * x * bell * series).otherwise(bell / math.sqrt(math.pi) / fraction)


def _column(z: str | Column) -> Column:
    return (F.col(z) if isinstance(z, str) else z).cast("double")


def normal_two_sided(z: str | Column) -> Column:
    """Share of a normal distribution that lies further out than z, on both sides; columns only."""
    return _erfc(F.abs(_column(z)) / math.sqrt(2.0))


def normal_cdf(z: str | Column) -> Column:
    """Share of a normal distribution below z; columns only."""
    x = _column(z)
    tail = _erfc(F.abs(x) / math.sqrt(2.0)) / 2.0
    return F.when(x < 0, tail).otherwise(1.0 - tail)


def t_tail(t: str | Column, df: str | Column) -> Column:
    return _t_tail(t, df)


def chi2_tail(x: str | Column, dof: str | Column) -> Column:
    return _chi2_tail(x, dof)


def chi2_1_upper(p: str | Column) -> Column:
    """The chi-square value with one degree of freedom whose upper tail is p."""
    return _chi2_1_upper(p)
