"""Exact tests of hit rates: tails of the binomial distribution by the regularised incomplete beta function, and its inverse."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-300


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised, of positive a and b and x in [0, 1]: a continued fraction (Lentz), on the side where it converges fast; small values keep their relative precision down to 1e-300."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inner = (y > 0) & (y < 1)
    safe = np.where(inner, y, 0.5)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    front = gamma(p + q) - gamma(p) - gamma(q) + p * np.log(safe) + q * np.log1p(-safe) - np.log(p)
    c, d = np.ones_like(p), 1 / floored(1 - (p + q) * safe / (p + 1))
    f = d.copy()
    for m in range(1, 20_000):
        for step in (m * (q - m) * safe / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * safe / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / floored(1 + step * d)
            c = floored(1 + step / c)
            f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    value = np.where(inner, np.exp(front) * f, np.where(y <= 0, 0.0, 1.0))
    return np.clip(np.where(turn, 1 - value, value), 0.0, 1.0)


def floored(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < TINY, TINY, x)


def upper_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The chance of k hits or more in n tries."""
    k, n, p = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(k, n, p))
    some = (k >= 1) & (k <= n)
    return np.where(k < 1, 1.0, np.where(k > n, 0.0, incomplete_beta(np.where(some, k, 1), np.where(some, n - k + 1, 1), p)))


def lower_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The chance of k hits or fewer."""
    return upper_tail(n - k, n, 1 - p)


def bound(k: np.ndarray, n: np.ndarray, chance: float, lower: bool) -> np.ndarray:
    """The rate at which k hits or more (lower bound), or k or fewer, have the chance given: by bisection."""
    low, high = np.zeros(len(k)), np.ones(len(k))
    for _ in range(100):
        middle = (low + high) / 2
        up = upper_tail(k, n, middle) < chance if lower else lower_tail(k, n, middle) > chance
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return np.where(k <= 0, 0.0, low) if lower else np.where(k >= n, 1.0, high)


OUT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("p_upper", "p_value", "low", "high")])


def hit_rate_test(hits: str | Column, tries: str | Column, rate: float = 0.5, level: float = 0.95) -> Column:
    """V20. A struct for each row of a report: the chance of as many hits or more at the rate given, the two-sided p-value (twice the smaller tail, 1 at most), and the exact (Clopper-Pearson) interval of the true rate. Null where tries is null or 0."""

    @F.pandas_udf(OUT)
    def test(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        k, n = k.to_numpy(dtype=float, na_value=np.nan), n.to_numpy(dtype=float, na_value=np.nan)
        ok = (n > 0) & (k >= 0) & (k <= n)
        k, n = np.where(ok, k, 0.0), np.where(ok, n, 1.0)
        up, down = upper_tail(k, n, np.full(len(k), rate)), lower_tail(k, n, np.full(len(k), rate))
        found = (up, np.minimum(1.0, 2 * np.minimum(up, down)), bound(k, n, (1 - level) / 2, True), bound(k, n, (1 - level) / 2, False))
        return pd.DataFrame({c: pd.Series(v).astype(object).where(ok, None) for c, v in zip(("p_upper", "p_value", "low", "high"), found)})

    return test(hits, tries)
