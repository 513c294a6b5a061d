"""Tail probabilities, which Spark has no functions for: small Arrow kernels over a column of statistics."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_STEPS = 300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    value = d
    for m in range(1, _STEPS):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + top * d or tiny)
            c = 1.0 + top / c or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return value


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for n in range(1, 10 * _STEPS):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1.0 - front * total
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    value = d
    for n in range(1, 10 * _STEPS):
        step = -n * (n - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * max(f, 0.0))) if min(d1, d2) > 0 else math.nan


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2) if df > 0 else math.nan


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@lru_cache(maxsize=64)
def _signed_rank_counts(n: int) -> np.ndarray:
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1
    for k in range(1, n + 1):
        counts[k:] = counts[k:] + counts[:-k]
    return counts


def signed_rank_two_sided(w: float, n: float, ties: float, variance: float) -> float:
    """P of Wilcoxon's smaller rank sum: exact up to 50 pairs without ties, else by the normal distribution."""
    n = int(n)
    if n < 1:
        return math.nan
    if n <= 50 and not ties:
        counts = _signed_rank_counts(n)
        return min(1.0, 2 * counts[: int(math.floor(w)) + 1].sum() / 2.0**n)
    return normal_two_sided((w - n * (n + 1) / 4) / math.sqrt(variance)) if variance > 0 else math.nan


def _column(kernel, *columns) -> Column:
    @F.pandas_udf("double")
    def tail(first: pd.Series, *rest: pd.Series) -> pd.Series:
        rows = zip(*(s.astype(float) for s in (first, *rest)))
        return pd.Series([kernel(*r) if all(map(math.isfinite, r)) else None for r in rows], dtype=float)

    return tail(*[F.col(c) if isinstance(c, str) else c for c in columns])


def t_p(t, df) -> Column:
    return _column(t_two_sided, t, df)


def f_p(f, d1, d2) -> Column:
    return _column(f_upper, f, d1, d2)


def chi2_p(x, df) -> Column:
    return _column(chi2_upper, x, df)


def normal_p(z) -> Column:
    return _column(normal_two_sided, z)


def signed_rank_p(w, n, ties, variance) -> Column:
    return _column(signed_rank_two_sided, w, n, ties, variance)
