"""Regime features (W29-W40): trend ladders, volatility classes, breadth and distance to extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qpanel.functions import orders
from qpanel.functions.windows import by_symbol, change, from_bar, high, lag, low, mean0, ratio, std, trailing

from .spec import FeatureSpec

CATEGORY = "regime"
VOL_CUTS = ((0.01, "low"), (0.025, "normal"), (0.04, "high"))


def vol_class(vol: Column) -> Column:
    out = F.when(vol < VOL_CUTS[0][0], VOL_CUTS[0][1])
    for cut, name in VOL_CUTS[1:]:
        out = out.when(vol < cut, name)
    return out.otherwise("crash")


def specs(warmup_as_reference: bool = False) -> list[FeatureSpec]:
    """With warmup_as_reference, ladders in their warm-up get the class that a missing value falls to instead of NULL."""
    c = F.col("close")
    s20, s50, s200, v20 = (F.col(x) for x in ("_r_sma_20", "_r_sma_50", "_r_sma_200", "_r_vol_20"))
    out: list[FeatureSpec] = []

    def add(name, lookback, column=None, needs=(), inputs=("close",)):
        out.append(FeatureSpec(name, CATEGORY, lookback, column, tuple(needs), tuple(inputs)))

    def known(x: Column, *parts: Column) -> Column:
        if warmup_as_reference:
            return x
        complete = parts[0].isNotNull()
        for p in parts[1:]:
            complete = complete & p.isNotNull()
        return F.when(complete, x)

    for w in (20, 50, 200):
        add(f"_r_sma_{w}", w, mean0("close", w))
    add("_r_vol_20", 21, std("returns", 20, 21))
    ladder = F.when((c > s20) & (s20 > s50), 3).when((c > s20) & (c > s50), 2).when(c > s50, 1).otherwise(0)
    add("sma20_50_alignment", 50, known(ladder.cast("double"), s20, s50), ["_r_sma_20", "_r_sma_50"])
    add("trend_strength", 60, change("_r_sma_50", 10), ["_r_sma_50"])
    points = F.when(c > s50, 1).otherwise(0) + F.when(c > s200, 1).otherwise(0) + F.when(v20 < 0.025, 1).otherwise(0)
    add("regime_score", 200, known(points.cast("double"), s50, s200, v20), ["_r_sma_50", "_r_sma_200", "_r_vol_20"])
    add("vol_regime", 21, known(vol_class(v20), v20), ["_r_vol_20"])
    add("_above", 20, F.when(c > s20, 1.0).otherwise(0.0), ["_r_sma_20"])
    add("breadth_sma20", 10, from_bar(F.sum("_above").over(trailing(10)), 10), ["_above"])
    before = by_symbol().rowsBetween(-20, -1)
    h, l = F.col("high"), F.col("low")
    sides = F.when(h > F.max("high").over(before), 1.0).otherwise(0.0) - F.when(l < F.min("low").over(before), 1.0).otherwise(0.0)
    add("hh_ll_20d", 21, from_bar(sides, 21), inputs=["high", "low"])
    up, down = h - lag("high"), lag("low") - l
    add("_dm_up", 2, F.when((up > down) & (up > 0), up).otherwise(0.0), inputs=["high", "low"])
    add("_dm_down", 2, F.when((down > up) & (down > 0), down).otherwise(0.0), inputs=["high", "low"])
    di = [ratio(mean0(x, 14) * 100, F.col("atr_14")) for x in ("_dm_up", "_dm_down")]
    add("_di_up", 15, from_bar(di[0], 15), ["_dm_up", "atr_14"])
    add("_di_down", 15, from_bar(di[1], 15), ["_dm_down", "atr_14"])
    a, b = F.col("_di_up"), F.col("_di_down")
    add("adx_proxy_14", 15, ratio(F.abs(a - b), a + b) * 100, ["_di_up", "_di_down"], ["high", "low", "close"])
    add("vol_expansion", 81, from_bar(ratio(v20, F.avg("_r_vol_20").over(trailing(61))), 81), ["_r_vol_20"])
    add("dist_52w_high", 253, ratio(c, high("high", 253)), inputs=["close", "high"])
    add("dist_52w_low", 253, ratio(c, low("low", 253)), inputs=["close", "low"])
    return out


def market_bucket(score: Column) -> Column:
    """W38. bull above 2, bear below 1, sideways between."""
    return F.when(score > 2, "bull").when(score < 1, "bear").when(score.isNotNull(), "sideways")


def market_breadth(features: DataFrame, sma: str = "sma_20") -> DataFrame:
    """W39. For each date the share of symbols above their mean; one small row per date is shuffled from each task."""
    return features.groupBy("date").agg(F.avg(F.when(F.col(sma).isNotNull(), (F.col("close") > F.col(sma)).cast("double"))).alias("breadth"), F.count(sma).alias("n_symbols"))


def trailing_percentile(x: str, n: int) -> Column:
    """W40. Share of the last n values at or below the current one."""
    return F.when(
        F.col(x).isNotNull() & (F.count(x).over(trailing(n)) >= n),
        F.aggregate(F.collect_list(x).over(trailing(n)), F.lit(0), lambda s, y: s + F.when(y <= F.col(x), 1).otherwise(0)) / n,
    )




def expanding_percentiles(df: DataFrame, columns: dict[str, str], least: int = 60) -> DataFrame:
    """W40. df with the percentile of each column's value within its symbol's own history so far, from least values on: columns maps new names to old ones."""
    return orders.added(df, {new: (lambda f, c=old: orders.expanding_percentile(orders.numbers(f, c), least)) for new, old in columns.items()})
