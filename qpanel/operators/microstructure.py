"""Liquidity and order-flow proxies from daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from qpanel.functions.windows import from_bar, lag, mean0, ratio, running, trailing

from .spec import FeatureSpec

CATEGORY = "microstructure"


def specs() -> list[FeatureSpec]:
    h, l, c, v, r = (F.col(x) for x in ("high", "low", "close", "volume", "returns"))
    before = lag("close")
    out: list[FeatureSpec] = []

    def add(name, lookback, column, needs=(), inputs=("close", "volume")):
        out.append(FeatureSpec(name, CATEGORY, lookback, column, tuple(needs), tuple(inputs)))

    add("signed_volume", 2, v * F.signum(c - before))
    add("cum_signed_volume", 1, F.sum(F.coalesce(F.col("signed_volume"), F.lit(0.0))).over(running()), ["signed_volume"])
    for w in (5, 10, 20):
        add(f"_flow_{w}", w, mean0("signed_volume", w), ["signed_volume"])
        add(f"ofi_{w}d", w, ratio(F.col(f"_flow_{w}"), mean0("volume", w)), [f"_flow_{w}"])
    add("_typical", 1, (h + l + c) / 3, inputs=["high", "low", "close"])
    flow = F.sum(F.coalesce(F.col("_typical") * v, F.lit(0.0))).over(running())
    add("vwap_proxy", 1, ratio(flow, F.sum(F.coalesce(v, F.lit(0.0))).over(running())), ["_typical"])
    add("vwap_deviation", 1, ratio(c - F.col("vwap_proxy"), F.col("vwap_proxy")), ["vwap_proxy"])
    add("spread_proxy", 1, ratio(h - l, c), inputs=["high", "low", "close"])
    add("spread_proxy_ma20", 20, mean0("spread_proxy", 20), ["spread_proxy"], ["high", "low", "close"])
    add("close_location", 1, ratio(c - l, h - l), inputs=["high", "low", "close"])
    add("amihud_illiquidity", 1, ratio(F.abs(r), v * c))
    add("amihud_ma20", 20, mean0("amihud_illiquidity", 20), ["amihud_illiquidity"])
    add("_vol_ma_20", 20, mean0("volume", 20))
    add("volume_climax", 20, ratio(v, F.col("_vol_ma_20")), ["_vol_ma_20"])
    add("intraday_range_pct", 1, ratio(h - l, c), inputs=["high", "low", "close"])
    add("_up_volume", 2, F.when(r > 0, v).otherwise(0.0))
    add("_down_volume", 2, F.when(r < 0, v).otherwise(0.0))
    add("up_down_vol_ratio", 10, ratio(mean0("_up_volume", 10), mean0("_down_volume", 10)), ["_up_volume", "_down_volume"])
    impact = F.when(v * c > 0, F.abs(r) / (v * c))
    add("kyles_lambda", 21, from_bar(F.when(F.count(impact).over(trailing(20)) > 5, F.avg(impact).over(trailing(20))), 21))
    add("downward_pressure", 20, F.when(F.col("_vol_ma_20").isNotNull(), ((c < before) & (v > F.col("_vol_ma_20"))).cast("double")), ["_vol_ma_20"])
    return out
