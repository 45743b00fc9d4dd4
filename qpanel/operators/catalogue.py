"""Indicators and contexts of the wider catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qpanel.functions.windows import across, by_symbol, from_bar, high, lag, low, mean0, ratio, running, std, trailing

from .spec import FeatureSpec

CATEGORY = "catalogue"


def weighted(x: str, n: int) -> Column:
    """Linearly weighted mean of n rows, the latest weighing most."""
    total = sum(F.lag(x, n - k).over(by_symbol()) * k if k < n else F.col(x) * n for k in range(1, n + 1))
    return from_bar(total / (n * (n + 1) / 2), n)


def rows_since(x: str, n: int, biggest: bool) -> Column:
    """How many rows ago the latest extreme of the last n rows lies."""
    pick = F.max_by("i", F.struct(F.col(x), "i")) if biggest else F.max_by("i", F.struct(-F.col(x), F.col("i")))
    return from_bar((F.col("i") - pick.over(trailing(n))).cast("double"), n)


def specs() -> list[FeatureSpec]:
    o, h, l, c, v, r = (F.col(x) for x in ("open", "high", "low", "close", "volume", "returns"))
    out: list[FeatureSpec] = []

    def add(name, lookback, column=None, needs=(), inputs=("high", "low", "close", "volume")):
        out.append(FeatureSpec(name, CATEGORY, lookback, column, tuple(needs), tuple(inputs)))

    before = lag("close")
    # Pullback and swing state
    add("_top_20", 20, high("high", 20))
    add("depth_from_high_20", 20, ratio(c - F.col("_top_20"), F.col("_top_20")), ["_top_20"])
    add("bars_since_high_20", 20, rows_since("high", 20, True))
    add("bars_since_low_20", 20, rows_since("low", 20, False))
    add("_inside", 2, ((h <= lag("high")) & (l >= lag("low"))).cast("double"))
    add("_higher_low", 2, (l > lag("low")).cast("double"))
    add("inside_days_10", 11, from_bar(F.sum("_inside").over(trailing(10)), 11), ["_inside"])
    add("higher_lows_10", 11, from_bar(F.sum("_higher_low").over(trailing(10)), 11), ["_higher_low"])
    # Expansion and contraction
    add("_mean_range_5", 5, mean0(h - l, 5))
    add("_mean_range_20", 20, mean0(h - l, 20))
    add("range_contraction", 20, ratio(F.col("_mean_range_5"), F.col("_mean_range_20")), ["_mean_range_5", "_mean_range_20"])
    add("base_width_20", 20, ratio(high("high", 20) - low("low", 20), c))
    add("volume_dry_up", 20, ratio(mean0("volume", 5), mean0("volume", 20)))
    # Deviation scores
    add("_c_mean_20", 20, mean0("close", 20))
    add("_c_std_20", 20, std("close", 20))
    add("price_z_20", 20, ratio(c - F.col("_c_mean_20"), F.col("_c_std_20")), ["_c_mean_20", "_c_std_20"])
    add("atr_deviation", 20, ratio(c - F.col("_c_mean_20"), F.col("atr_14")), ["_c_mean_20", "atr_14"])
    # Exhaustion and reclaim
    prior = by_symbol().rowsBetween(-10, -1)
    add("undercut_reclaim", 11, from_bar(((l < F.min("low").over(prior)) & (c > F.min("low").over(prior))).cast("double"), 11))
    add("back_inside_range", 12, from_bar(((before > F.max("high").over(by_symbol().rowsBetween(-11, -2))) & (c <= F.max("high").over(by_symbol().rowsBetween(-11, -2)))).cast("double"), 12))
    add("_climax", 20, ratio(v, mean0("volume", 20)))
    add("climax_fade", 21, F.when(lag("_climax").isNotNull(), ((lag("_climax") >= 2) & (v < lag("volume"))).cast("double")), ["_climax"])
    # Range-based volatility
    add("realised_vol_20", 21, from_bar(F.sqrt(F.sum(r * r).over(trailing(20))), 21))
    add("parkinson_20", 20, from_bar(F.sqrt(F.sum(F.pow(F.ln(h / l), F.lit(2))).over(trailing(20)) / (20 * 4 * 0.6931471805599453)), 20))
    add("_vol_20", 21, std("returns", 20, 21))
    add("vol_of_vol_20", 40, from_bar(F.stddev_pop("_vol_20").over(trailing(20)), 40), ["_vol_20"])
    # Window-expressible indicators
    add("wma_10", 10, weighted("close", 10))
    add("vwma_20", 20, from_bar(F.try_divide(F.sum(c * v).over(trailing(20)), F.sum("volume").over(trailing(20))), 20))
    add("roc_10", 11, 100 * ratio(c - lag("close", 10), lag("close", 10)))
    add("_lo_14", 14, low("low", 14))
    add("_hi_14", 14, high("high", 14))
    add("stoch_k_14", 14, 100 * ratio(c - F.col("_lo_14"), F.col("_hi_14") - F.col("_lo_14")), ["_lo_14", "_hi_14"])
    add("stoch_d_14", 16, from_bar(F.avg("stoch_k_14").over(trailing(3)), 16), ["stoch_k_14"])
    add("williams_r_14", 14, -100 * ratio(F.col("_hi_14") - c, F.col("_hi_14") - F.col("_lo_14")), ["_lo_14", "_hi_14"])
    add("_tp", 1, (h + l + c) / 3)
    add("_tp_list", 20, from_bar(F.collect_list("_tp").over(trailing(20)), 20), ["_tp"])
    mean_tp = F.aggregate("_tp_list", F.lit(0.0), lambda s, x: s + x) / 20
    add("_tp_mean", 20, mean_tp, ["_tp_list"])
    add("_tp_dev", 20, F.aggregate("_tp_list", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_tp_mean"))) / 20, ["_tp_list", "_tp_mean"])
    add("cci_20", 20, ratio(F.col("_tp") - F.col("_tp_mean"), 0.015 * F.col("_tp_dev")), ["_tp", "_tp_mean", "_tp_dev"])
    add("aroon_up_25", 26, 100 * (25 - rows_since("high", 26, True)) / 25)
    add("aroon_down_25", 26, 100 * (25 - rows_since("low", 26, False)) / 25)
    add("keltner_upper", 20, F.col("ema_20") + 2 * F.col("atr_14"), ["ema_20", "atr_14"])
    add("keltner_lower", 20, F.col("ema_20") - 2 * F.col("atr_14"), ["ema_20", "atr_14"])
    add("hist_vol_20", 21, from_bar(F.stddev_samp("log_returns").over(trailing(20)) * 252**0.5, 21))
    add("obv", 1, F.sum(F.coalesce(v * F.signum(c - before), F.lit(0.0))).over(running()))
    add("_flow", 1, F.col("_tp") * v, ["_tp"])
    add("_rise", 2, F.signum(F.col("_tp") - lag("_tp")), ["_tp"])
    up, down = (F.sum(F.when(F.col("_rise") == s, F.col("_flow")).otherwise(0.0)).over(trailing(14)) for s in (1, -1))
    add("mfi_14", 15, from_bar(F.when(up + down > 0, 100 * up / (up + down)), 15), ["_flow", "_rise"])
    add("_mfv", 1, F.coalesce(ratio((c - l) - (h - c), h - l), F.lit(0.0)) * v)
    add("adl", 1, F.sum("_mfv").over(running()), ["_mfv"])
    add("cmf_20", 20, from_bar(F.try_divide(F.sum("_mfv").over(trailing(20)), F.sum("volume").over(trailing(20))), 20), ["_mfv"])
    add("pivot", 2, (lag("high") + lag("low") + before) / 3)
    add("pivot_r1", 2, 2 * F.col("pivot") - lag("low"), ["pivot"])
    add("pivot_s1", 2, 2 * F.col("pivot") - lag("high"), ["pivot"])
    # recursions
    for name, n in (("tema_20", 58), ("trix_15", 44), ("tsi_25_13", 39), ("ppo_12_26", 26), ("kama_10", 11), ("supertrend_10_3", 11), ("psar", 2)):
        add(name, n)
    del o
    return out


def cross_sectional_momentum(panel: DataFrame, sector: Column, long: int = 252, skip: int = 21) -> DataFrame:
    """W68. Return from long to skip bars ago: its rank and z-score among the date's symbols, and within their sector."""
    then, now = lag("close", long), lag("close", skip)
    df = panel.withColumns({"sector": sector, "momentum": F.when(then > 0, now / then - 1)}).filter("momentum IS NOT NULL")
    x = across()
    return df.withColumns(
        {
            "momentum_rank": F.percent_rank().over(x.orderBy("momentum")),
            "momentum_z": F.try_divide(F.col("momentum") - F.avg("momentum").over(x), F.stddev_pop("momentum").over(x)),
            "sector_rank": F.percent_rank().over(Window.partitionBy("date", "sector").orderBy("momentum")),
        }
    ).select("symbol", "date", "sector", "momentum", "momentum_rank", "momentum_z", "sector_rank")


def breadth_lines(panel: DataFrame) -> DataFrame:
    """W71. Advances and declines of each date, their ratio and running line, and the McClellan oscillator (19- and 39-day EMA of the net).

    A row per date is left after the aggregate, so the recursion runs over few rows.
    """
    from qpanel.functions.kernels import ema

    days = panel.filter("i > 1").groupBy("date").agg(F.count_if(F.col("returns") > 0).alias("advances"), F.count_if(F.col("returns") < 0).alias("declines"))
    days = days.withColumn("net", F.col("advances") - F.col("declines")).withColumn("ad_line", F.sum("net").over(Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumn("ad_ratio", F.try_divide("advances", "declines"))

    def oscillate(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("date").reset_index(drop=True)
        net = frame["net"].to_numpy(dtype=float)
        value = ema(net, 19) - ema(net, 39)
        frame["mcclellan"] = pd.Series(value).astype(object).where(~np.isnan(value), None)
        return frame[["date", "advances", "declines", "net", "ad_line", "ad_ratio", "mcclellan"]]

    return days.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(oscillate, "date date, advances long, declines long, net long, ad_line long, ad_ratio double, mcclellan double")


def higher_timeframe(panel: DataFrame) -> DataFrame:
    """W65. Each bar with the trend of the last closed week: weekly closes, their 4-week mean, met as of the day after the week ends."""
    from .joins import asof

    week = panel.groupBy("symbol", F.date_trunc("week", "date").cast("date").alias("week")).agg(F.max_by("close", "date").alias("week_close"))
    w = Window.partitionBy("symbol").orderBy("week").rowsBetween(-3, 0)
    week = week.withColumns({"week_mean": F.avg("week_close").over(w), "known": F.date_add("week", 7)})
    df = asof(panel.select("symbol", "date", "close"), week, ["symbol"], "date", "known", ["week_close", "week_mean"])
    return df.withColumn("weekly_trend", F.signum(F.col("week_close") - F.col("week_mean")))


def relative_context(bars: DataFrame) -> DataFrame:
    """W65, W72. Return against market and sector, the sector against the market, days to the month's end; bars with both benchmarks joined."""
    return bars.withColumns({"vs_market": F.col("returns") - F.col("market_return"), "vs_sector": F.col("returns") - F.col("sector_return"), "sector_vs_market": F.col("sector_return") - F.col("market_return"), "days_to_month_end": F.date_diff(F.last_day("date"), "date")})
