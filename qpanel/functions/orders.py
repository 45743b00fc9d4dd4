"""Order statistics and first passages over one symbol's bars, in n log n steps whatever the window."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def at_most_so_far(x: np.ndarray) -> np.ndarray:
    """For each value how many of those up to its place, itself included, are at most as large; 0 for NaN, which counts for none.

    Blocks of twice the size each time: all values of right halves look up their place
    among the sorted values of their left halves at once.
    """
    valid = np.flatnonzero(~np.isnan(x))
    n, out = len(valid), np.zeros(len(x), dtype=np.int64)
    rank = np.unique(x[valid], return_inverse=True)[1].astype(np.int64)
    count, at, width = np.ones(n, dtype=np.int64), np.arange(n), 1
    while width < n:
        block, right = at // (2 * width), (at // width) % 2 == 1
        key = block * (n + 1) + rank
        left = np.sort(key[~right])
        start = np.searchsorted(left, block[right] * (n + 1))
        count[right] += np.searchsorted(left, key[right], side="right") - start
        width *= 2
    out[valid] = count
    return out


def expanding_percentile(x: np.ndarray, least: int) -> np.ndarray:
    """The share of all values so far that are at most as large as the current one, from least values on."""
    seen = np.cumsum(~np.isnan(x))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(x) | (seen < least), np.nan, at_most_so_far(x) / seen)


def first_at_most(x: np.ndarray, level: np.ndarray, horizon: int) -> np.ndarray:
    """How many places after each one x is first at or below its level, within the horizon; NaN if it isn't or the level is NaN. A NaN of x never is.

    Minima of ranges of 1, 2, 4, ... places; all rows skip the longest ranges first in
    which nothing is low enough.
    """
    n = len(x)
    table = [np.where(np.isnan(x), np.inf, x)]
    while 2 ** len(table) <= min(n, horizon):
        half = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    at = np.arange(n) + 1
    end = np.minimum(np.arange(n) + 1 + horizon, n)
    # twice each length: the horizon may be just short of the next power
    for k in [k for k in range(len(table) - 1, -1, -1) for _ in (0, 1)]:
        fits = at + 2**k <= end
        skip = fits.copy()
        skip[fits] = ~(table[k][at[fits]] <= level[fits])
        at = at + skip * 2**k
    return np.where((at < end) & ~np.isnan(level), (at - np.arange(n)).astype(float), np.nan)


def first_at_least(x: np.ndarray, level: np.ndarray, horizon: int) -> np.ndarray:
    return first_at_most(-x, -level, horizon)


def added(bars: DataFrame, columns: dict[str, Callable[[pd.DataFrame], np.ndarray]]) -> DataFrame:
    """bars with columns made of each symbol's rows in order of date; one shuffle by symbol. NaN is null."""
    schema = T.StructType([*bars.schema.fields, *[T.StructField(n, T.DoubleType()) for n in columns]])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date", kind="stable").reset_index(drop=True)
        for n, f in columns.items():
            values = np.asarray(f(frame), dtype=float)
            frame[n] = pd.Series(values).astype(object).where(~np.isnan(values), None)
        return frame

    return bars.groupBy("symbol").applyInPandas(add, schema)


def numbers(frame: pd.DataFrame, column: str) -> np.ndarray:
    return frame[column].to_numpy(dtype=float, na_value=np.nan)
