"""Technical features (W1-W16): means, bands, channels, volume, and recursive oscillators."""

from __future__ import annotations

from pyspark.sql import functions as F

from qpanel.functions.windows import change, high, low, mean0, ratio, std

from .spec import FeatureSpec

CATEGORY = "technical"


def specs(windows: tuple[int, ...] = (5, 10, 20, 50, 200), bb_window: int = 20, bb_std: float = 2.0, donchian: tuple[int, ...] = (20, 50)) -> list[FeatureSpec]:
    c, v = F.col("close"), F.col("volume")
    out: list[FeatureSpec] = []

    def add(name, lookback, column=None, needs=(), inputs=("close",)):
        out.append(FeatureSpec(name, CATEGORY, lookback, column, tuple(needs), tuple(inputs)))

    for w in windows:
        sma = F.col(f"sma_{w}")
        add(f"sma_{w}", w, mean0("close", w))
        add(f"dist_sma_{w}", w, ratio(c - sma, sma), [f"sma_{w}"])
        add(f"sma_{w}_slope", w + 5, change(f"sma_{w}", 5), [f"sma_{w}"])
        add(f"vol_ma_{w}", w, mean0("volume", w), inputs=["volume"])
        add(f"rvol_{w}", w, ratio(v, F.col(f"vol_ma_{w}")), [f"vol_ma_{w}"], ["volume"])
    for n in (10, 20):
        add(f"ema_{n}", n)
    add("ema_cross", 20, ratio(F.col("ema_10") - F.col("ema_20"), F.col("ema_20")), ["ema_10", "ema_20"])
    for n in (2, 7, 14):
        add(f"rsi_{n}", n + 1)
    add("_bb_mean", bb_window, mean0("close", bb_window))
    add("_bb_std", bb_window, std("close", bb_window))
    mean, dev, upper, lower = F.col("_bb_mean"), F.col("_bb_std"), F.col("bb_upper"), F.col("bb_lower")
    add("bb_upper", bb_window, mean + bb_std * dev, ["_bb_mean", "_bb_std"])
    add("bb_lower", bb_window, mean - bb_std * dev, ["_bb_mean", "_bb_std"])
    add("bb_width", bb_window, ratio(upper - lower, mean), ["bb_upper", "bb_lower"])
    add("bb_position", bb_window, ratio(c - lower, upper - lower), ["bb_upper", "bb_lower"])
    for n in (7, 14):
        add(f"atr_{n}", n + 1, inputs=["high", "low", "close"])
        add(f"atr_{n}_pct", n + 1, ratio(F.col(f"atr_{n}"), c), [f"atr_{n}"], ["high", "low", "close"])
    add("macd", 26)
    add("macd_signal", 34)
    add("macd_histogram", 34, F.col("macd") - F.col("macd_signal"), ["macd", "macd_signal"])
    add("swing_low_5d", 5, low("low", 5), inputs=["low"])
    add("swing_high_5d", 5, high("high", 5), inputs=["high"])
    for w in donchian:
        top, bottom = F.col(f"donchian_high_{w}"), F.col(f"donchian_low_{w}")
        add(f"donchian_high_{w}", w, high("high", w), inputs=["high"])
        add(f"donchian_low_{w}", w, low("low", w), inputs=["low"])
        add(f"donchian_pos_{w}", w, ratio(c - bottom, top - bottom), [f"donchian_high_{w}", f"donchian_low_{w}"], ["close", "high", "low"])
    add("hurst_100", 101)
    return out
