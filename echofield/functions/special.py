"""Tail probabilities for test statistics, applied to result-sized tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


ROUNDS = 1_000_000


def _rest(z: float) -> float:
    """ln Gamma(z) less (z - 1/2) ln z - z + ln(2 pi)/2; the first term left out is below 1e-16 for z >= 10."""
    w = 1.0 / (z * z)
    series = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
    return sum(c * w**i for i, c in enumerate(series)) / z


def _ln_front(a: float, b: float, x: float, y: float) -> float:
    """ln(x**a y**b / B(a, b)) without subtracting two large log-gammas."""
    ln_x = math.log1p(-y) if y < 0.5 else math.log(x)
    ln_y = math.log1p(-x) if x < 0.5 else math.log(y)
    small, large = min(a, b), max(a, b)
    if large < 10.0:
        return a * ln_x + b * ln_y + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    # ln Gamma(a + b) - ln Gamma(large), from the difference of their Stirling series
    rise = (large - 0.5) * math.log1p(small / large) + small * math.log(a + b) - small + _rest(a + b) - _rest(large)
    if small < 10.0:
        return a * ln_x + b * ln_y + rise - math.lgamma(small)
    # Both large: each power against its own mode.
    return (
        a * (ln_x + math.log1p(b / a)) + b * (ln_y + math.log1p(a / b))
        + 0.5 * math.log(a / (a + b) * b / (2.0 * math.pi)) + _rest(a + b) - _rest(a) - _rest(b)
    )


def _betainc(a: float, b: float, x: float, y: float) -> float:
    """Regularised incomplete beta function at x, with y = 1 - x given so that neither is rounded.

    The continued fraction of Didonato and Morris (1992), run until it stands
    still.  It works with the distance from the mean instead of with 1 - x, so
    it keeps its digits for parameters of any size.
    """
    if x != x or y != y or a <= 0 or b <= 0:
        return math.nan
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    below = a - (a + b) * x if a <= b else (a + b) * y - b
    if below < 0.0:
        return 1.0 - _betainc(b, a, y, x)
    before, now = (0.0, 1.0), (1.0, (1.0 + below) / (1.0 + 1.0 / a))
    ratio = now[0] / now[1]
    for n in range(1, ROUNDS):
        s = a + 2 * n - 1
        w = n * (b - n) * x
        alpha = (1 + (n - 1) / a) * (1 + (n - 1) / a + b / a) * (a / s) ** 2 * w * x
        beta = n + w / s + (1 + n / a) / (1 + 1 / a + 2 * n / a) * (1 + below + n * (1 + y))
        upper, lower = alpha * before[0] + beta * now[0], alpha * before[1] + beta * now[1]
        last, ratio = ratio, upper / lower
        if abs(ratio - last) <= 1e-15 * abs(ratio):
            return math.exp(_ln_front(a, b, x, y)) * ratio
        before, now = (now[0] / lower, now[1] / lower), (ratio, 1.0)
    raise ArithmeticError(f"incomplete beta function did not converge at a={a}, b={b}, x={x}")


@F.pandas_udf(T.DoubleType())
def betainc(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([_betainc(*v) for v in zip(a, b, x, y)], dtype="float64")


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F >= f) with df1 and df2 degrees of freedom."""
    d1, d2 = df1.cast("double"), df2.cast("double")
    whole = d2 + d1 * f
    return betainc(d2 / 2.0, d1 / 2.0, d2 / whole, d1 * f / whole)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) with df degrees of freedom."""
    d = df.cast("double")
    return betainc(d / 2.0, F.lit(0.5), d / (d + t * t), t * t / (d + t * t))


def kolmogorov_tail(lam: Column, terms: int = 100) -> Column:
    """Asymptotic P(K >= lam): 2 * sum (-1)^(j-1) exp(-2 j^2 lam^2), in [0, 1]."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc
        + F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        * F.exp(F.lit(-2.0) * j * j * lam * lam),
    )
    # Below 0.04 the alternating series needs more terms than it is worth: the tail is 1.
    return F.when(lam < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
