"""Distribution functions: on numbers for driver-side finalisers, on columns as Arrow functions for small aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def normal_isf(p: float) -> float:
    """Inverse of normal_sf, by bisection in the tail's own scale."""
    if not 0.0 < p < 1.0:
        return math.inf if p == 0 else -math.inf if p == 1 else math.nan
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_sf(mid) > p else (lo, mid)
    return (lo + hi) / 2


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0
    return tail if t >= 0 else 1 - tail


def t_cdf(t: float, df: float) -> float:
    return t_sf(-t, df)


def t_isf(p: float, df: float) -> float:
    lo, hi = -1.0, 1.0
    while t_sf(hi, df) > p:
        hi *= 2
    while t_sf(lo, df) < p:
        lo *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf(mid, df) > p else (lo, mid)
    return (lo + hi) / 2


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided p of the signed-rank statistic min(W+, W-) without ties or zeros, by counting subsets."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] = ways[k:] + ways[:-k].copy()
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))


def kolmogorov_sf(d: float, n: float) -> float:
    """Asymptotic p of a Kolmogorov-Smirnov distance d with effective size n."""
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return 1.0 if x < 0.2 else max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def _column(f):
    @F.pandas_udf(DoubleType())
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda v: f(float(v)) if pd.notna(v) else None).astype(float)

    return of


erfc = _column(math.erfc)


def _column2(f):
    @F.pandas_udf(DoubleType())
    def of(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([f(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x, df)], dtype=float)

    return of


t_sf_col = _column2(t_sf)
t_isf_col = _column2(t_isf)


def normal_sf_col(z):
    return 0.5 * erfc(z / F.lit(math.sqrt(2.0)))


def normal_two_sided(z):
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))
