"""Distribution functions that Spark and numpy lack, on numpy arrays or floats."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def erfc(x):
    return _erfc(x) if isinstance(x, np.ndarray) else math.erfc(x)


def lgamma(x):
    return _lgamma(x) if isinstance(x, np.ndarray) else math.lgamma(x)


def normal_two_sided(z):
    return erfc(np.abs(z) / math.sqrt(2.0))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-squared for one or two degrees of freedom."""
    if not x >= 0:
        return math.nan
    if df == 1:
        return math.erfc(math.sqrt(x / 2.0))
    if df == 2:
        return math.exp(-x / 2.0)
    raise ValueError("Only one or two degrees of freedom.")


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else math.nan
    return betainc(df / 2.0, 0.5, df / (df + t * t)) if df > 0 else math.nan


def t_quantile(p: float, df: float) -> float:
    """Upper quantile: the t with probability ``p`` below it, by bisection on the tail."""
    if df <= 0:
        return math.nan
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    low, high = 0.0, 1.0
    while 1.0 - t_two_sided(high, df) / 2.0 < p:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if 1.0 - t_two_sided(mid, df) / 2.0 < p else (low, mid)
    return (low + high) / 2.0


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 10).any():
        small = x < 10
        out[small] -= 1.0 / x[small]
        x[small] += 1.0
    i = 1.0 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i * (1 / 132)))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 10).any():
        small = x < 10
        out[small] += 1.0 / x[small] ** 2
        x[small] += 1.0
    i = 1.0 / (x * x)
    return out + 1.0 / x + 0.5 * i + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * (5 / 66)))))


def finite(x) -> float | None:
    """A float, or null for what is not finite."""
    return float(x) if x is not None and math.isfinite(x) else None
