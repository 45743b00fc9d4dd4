"""Order-dependent recursions over one symbol's bars: the only Python code over rows.

Each kernel takes arrays in date order and returns one of the same length, NaN where
there is no value yet. They run inside one grouped map for all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ema(x: np.ndarray, period: int) -> np.ndarray:
    """Exponential mean seeded with the mean of the first period valid values."""
    out = np.full(len(x), np.nan)
    valid = np.flatnonzero(~np.isnan(x))
    if len(valid) < period:
        return out
    alpha = 2.0 / (period + 1)
    value = x[valid[:period]].mean()
    out[valid[period - 1]] = value
    for k in valid[period:]:
        value = alpha * x[k] + (1 - alpha) * value
        out[k] = value
    return out


def wilder(x: np.ndarray, period: int) -> np.ndarray:
    """Wilder's mean: the mean of x[1..period], then a share 1/period of each new value."""
    out = np.full(len(x), np.nan)
    if len(x) <= period:
        return out
    value = x[1 : period + 1].mean()
    out[period] = value
    for k in range(period + 1, len(x)):
        value += (x[k] - value) / period
        out[k] = value
    return out


def rsi(close: np.ndarray, period: int) -> np.ndarray:
    """Relative strength, defined up to the last bar; 100 where there was no loss."""
    if len(close) < period + 2:
        return np.full(len(close), np.nan)
    step = np.diff(close, prepend=close[0])
    up, down = wilder(np.maximum(step, 0), period), wilder(np.maximum(-step, 0), period)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(up), np.nan, np.where(down == 0, 100.0, 100.0 - 100.0 / (1.0 + up / down)))


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.r_[np.nan, close[:-1]]
    out = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    out[:1] = 0.0
    return out


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int) -> np.ndarray:
    return wilder(true_range(high, low, close), period)


def hurst(close: np.ndarray, lookback: int = 100, sizes: tuple[int, ...] = (10, 20, 40, 60)) -> np.ndarray:
    """Slope of the log rescaled range on the log chunk length, between 0 and 1.

    All windows of a symbol at once: rows of a strided view of the log returns. A window
    with a close of 0 or less has no value; the others are not touched by it.
    """
    n = len(close)
    out = np.full(n, np.nan)
    if n <= lookback:
        return out
    step = np.diff(np.log(np.where(close > 0, close, np.nan)))
    r = np.lib.stride_tricks.sliding_window_view(step, lookback)
    y = []
    for size in sizes:
        chunks = r[:, : lookback // size * size].reshape(len(r), -1, size)
        walk = np.cumsum(chunks - chunks.mean(axis=2, keepdims=True), axis=2)
        spread = chunks.std(axis=2)
        y.append(np.log(((walk.max(axis=2) - walk.min(axis=2)) / np.where(spread > 0, spread, 0.001)).mean(axis=1)))
    x = np.log(sizes)
    x = x - x.mean()
    with np.errstate(invalid="ignore"):
        slope = (np.array(y).T - np.mean(y, axis=0)[:, None]) @ x / (x @ x)
    out[lookback:] = np.clip(slope, 0.0, 1.0)
    return out


def half_life(stock: np.ndarray, bench: np.ndarray, window: int = 60, least: int = 20, block: int = 4096) -> np.ndarray:
    """-ln 2 / b of the residual walk's change on its level; infinite if it does not revert.

    Windows are the rows of strided views, block of them at once; missing pairs weigh nothing.
    """
    n = len(stock)
    out = np.full(n, np.nan)
    if n <= window:
        return out
    views = [np.lib.stride_tricks.sliding_window_view(x, window)[1:] for x in (stock, bench)]
    for at in range(0, n - window, block):
        s, e = (v[at : at + block] for v in views)
        ok = ~(np.isnan(s) | np.isnan(e))
        count = ok.sum(axis=1)

        def centred(x, present, number):
            mean = np.where(present, x, 0.0).sum(axis=1) / np.maximum(number, 1)
            return np.where(present, x - mean[:, None], 0.0)

        ds, de = centred(s, ok, count), centred(e, ok, count)
        flat = (de * de).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = ds - ((de * ds).sum(axis=1) / flat)[:, None] * de
            level = np.cumsum(step, axis=1) - step
            # a step counts from the second pair on, with the level before it
            later = ok & (np.cumsum(ok, axis=1) > 1)
            dl, dc = centred(level, later, count - 1), centred(step, later, count - 1)
            moved = (dl * dl).sum(axis=1)
            b = (dl * dc).sum(axis=1) / moved
            life = np.where(b >= 0, np.inf, -np.log(2) / b)
        out[window + at : window + at + len(count)] = np.where((count >= least) & (flat != 0) & (moved != 0), life, np.nan)
    return out


#: Output columns of the grouped map, each from a frame of one symbol.
KERNELS = {
    "ema_10": lambda p: ema(p.close, 10),
    "ema_20": lambda p: ema(p.close, 20),
    "macd": lambda p: ema(p.close, 12) - ema(p.close, 26),
    "macd_signal": lambda p: ema(ema(p.close, 12) - ema(p.close, 26), 9),
    "rsi_2": lambda p: rsi(p.close, 2),
    "rsi_7": lambda p: rsi(p.close, 7),
    "rsi_14": lambda p: rsi(p.close, 14),
    "atr_7": lambda p: atr(p.high, p.low, p.close, 7),
    "atr_14": lambda p: atr(p.high, p.low, p.close, 14),
    "hurst_100": lambda p: hurst(p.close, 100),
    "residual_half_life": lambda p: half_life(p.returns, p.bench_return),
    # catalogue indicators that recur
    "tema_20": lambda p: 3 * ema(p.close, 20) - 3 * ema(ema(p.close, 20), 20) + ema(ema(ema(p.close, 20), 20), 20),
    "trix_15": lambda p: percent_step(ema(ema(ema(p.close, 15), 15), 15)),
    "tsi_25_13": lambda p: 100 * divided(ema(ema(steps(p.close), 25), 13), ema(ema(np.abs(steps(p.close)), 25), 13)),
    "ppo_12_26": lambda p: 100 * divided(ema(p.close, 12) - ema(p.close, 26), ema(p.close, 26)),
    "kama_10": lambda p: kama(p.close, 10),
    "supertrend_10_3": lambda p: supertrend(p.high, p.low, p.close, 10, 3.0),
    "psar": lambda p: parabolic_sar(p.high, p.low),
}


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.nan)


def divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, np.nan)


def percent_step(x: np.ndarray) -> np.ndarray:
    before = np.r_[np.nan, x[:-1]]
    return 100 * divided(x - before, before)


def kama(x: np.ndarray, period: int, fast: int = 2, slow: int = 30) -> np.ndarray:
    """Adaptive mean whose speed follows the efficiency of the last period steps."""
    out = np.full(len(x), np.nan)
    if len(x) <= period:
        return out
    moved = np.abs(np.diff(x, prepend=x[0]))
    value = x[period - 1]
    for k in range(period, len(x)):
        path = moved[k - period + 1 : k + 1].sum()
        efficiency = abs(x[k] - x[k - period]) / path if path else 0.0
        speed = (efficiency * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
        value += speed * (x[k] - value)
        out[k] = value
    return out


def supertrend(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int, width: float) -> np.ndarray:
    """The trailing band on the side of the trend."""
    band = width * atr(high, low, close, period)
    middle, out = (high + low) / 2, np.full(len(close), np.nan)
    upper = lower = np.nan
    rising = True
    for k in range(len(close)):
        if np.isnan(band[k]):
            continue
        u, d = middle[k] + band[k], middle[k] - band[k]
        if np.isnan(upper):
            upper, lower = u, d
        else:
            upper = u if u < upper or close[k - 1] > upper else upper
            lower = d if d > lower or close[k - 1] < lower else lower
            if rising and close[k] < lower:
                rising, upper = False, u
            elif not rising and close[k] > upper:
                rising, lower = True, d
        out[k] = lower if rising else upper
    return out


def parabolic_sar(high: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    out = np.full(len(high), np.nan)
    if len(high) < 2:
        return out
    rising, sar, extreme, speed = True, low[0], high[0], step
    for k in range(1, len(high)):
        sar += speed * (extreme - sar)
        if rising:
            sar = min(sar, low[k - 1], low[max(0, k - 2)])
            if low[k] < sar:
                rising, sar, extreme, speed = False, extreme, low[k], step
            elif high[k] > extreme:
                extreme, speed = high[k], min(most, speed + step)
        else:
            sar = max(sar, high[k - 1], high[max(0, k - 2)])
            if high[k] > sar:
                rising, sar, extreme, speed = True, extreme, high[k], step
            elif low[k] < extreme:
                extreme, speed = low[k], min(most, speed + step)
        out[k] = sar
    return out


def with_kernels(bars: DataFrame, names: list[str]) -> DataFrame:
    """bars with the named kernel columns; one shuffle by symbol for all of them."""
    if not names:
        return bars
    columns = bars.columns
    schema = T.StructType([*bars.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date", kind="stable").reset_index(drop=True)

        class Bars:
            pass

        for c in ("open", "high", "low", "close", "volume", "returns", "bench_return"):
            if c in columns:
                setattr(Bars, c, frame[c].to_numpy(dtype=float))
        for n in names:
            values = KERNELS[n](Bars)
            frame[n] = pd.Series(values).astype(object).where(~np.isnan(values), None)
        return frame

    return bars.groupBy("symbol").applyInPandas(add, schema)
