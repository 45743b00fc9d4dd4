"""Statistical features (W17-W28): momentum, volatility, z-scores, moments, runs, correlation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from qpanel.functions.windows import by_symbol, from_bar, high, lag, low, mean0, ratio, safe_corr, std, trailing

from .spec import FeatureSpec

CATEGORY = "statistical"


def specs(windows: tuple[int, ...] = (5, 10, 20, 50, 100)) -> list[FeatureSpec]:
    c, v, r = F.col("close"), F.col("volume"), F.col("returns")
    out: list[FeatureSpec] = []

    def add(name, lookback, column, needs=(), inputs=("close",)):
        out.append(FeatureSpec(name, CATEGORY, lookback, column, tuple(needs), tuple(inputs)))

    for w in windows:
        before = lag("close", w)
        add(f"mom_{w}d", w + 1, F.when(before > 0, c / before - 1))
        add(f"_mean_{w}", w, mean0("close", w))
        earlier = lag(f"_mean_{w}", 5)
        add(f"mom_sma_{w}", w + 5, F.when(earlier > 0, F.col(f"_mean_{w}") / earlier - 1), [f"_mean_{w}"])
        add(f"vol_{w}d", w + 1, std("returns", w, w + 1))
    for w in (20, 50):
        add(f"_std_{w}", w, std("close", w))
        add(f"zscore_{w}d", w, ratio(c - F.col(f"_mean_{w}"), F.col(f"_std_{w}")), [f"_mean_{w}", f"_std_{w}"])
        some = F.count("returns").over(trailing(w)) > 5
        add(f"skew_{w}d", w + 1, from_bar(F.when(some, F.skewness(r).over(trailing(w))), w + 1))
        add(f"kurtosis_{w}d", w + 1, from_bar(F.when(some, F.kurtosis(r).over(trailing(w)) + 3), w + 1))
        add(f"pv_corr_{w}d", w + 1, from_bar(safe_corr(c, v, trailing(w)), w + 1), inputs=["close", "volume"])
    for w in (20, 100):
        add(f"_peak_{w}", w, high("close", w))
        add(f"_trough_{w}", w, low("close", w))
        peak, trough = F.col(f"_peak_{w}"), F.col(f"_trough_{w}")
        add(f"dd_{w}d", w, ratio(c - peak, peak), [f"_peak_{w}"])
        add(f"range_{w}d", w, ratio(peak - trough, trough), [f"_peak_{w}", f"_trough_{w}"])
    # runs: a bar that breaks the direction opens a new group, whose rows are then counted
    for name, goes_on in (("up", r > 0), ("down", r < 0)):
        breaks = F.when((F.col("i") > 1) & goes_on, 0).otherwise(1)
        add(f"_group_{name}", 1, F.sum(breaks).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
        inside = Window.partitionBy("symbol", f"_group_{name}").orderBy("date")
        add(f"consec_{name}", 2, (F.row_number().over(inside) - 1).cast("double"), [f"_group_{name}"])
    before = lag("close")
    add("daily_gap", 2, F.when(before > 0, c / before - 1))
    add("_move", 2, F.abs(c - before))
    for w in (10, 20):
        add(f"eff_ratio_{w}d", w + 1, from_bar(ratio(F.abs(c - lag("close", w)), F.sum("_move").over(trailing(w))), w + 1), ["_move"])
    return out


