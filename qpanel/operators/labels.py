"""Forward labels (L1-L10). Horizons count bars; the future is read by lead and by frames after the current row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qpanel.functions import orders
from qpanel.functions.windows import across, by_symbol

HORIZONS = (1, 3, 5, 10, 20)
LEAST_SYMBOLS = 5
PROFIT, STOP, HOLD = 0.05, 0.03, 10


def lead(x: str | Column, k: int) -> Column:
    return F.lead(x, k).over(by_symbol())


def forward_returns(panel: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """L1, L2. Simple and log returns over the next h bars."""
    c = F.col("close")
    out = {}
    for h in horizons:
        after = lead("close", h)
        out[f"forward_return_{h}d"] = F.when(c > 0, after / c - 1)
        out[f"log_forward_return_{h}d"] = F.when((c > 0) & (after > 0), F.ln(after / c))
    return panel.withColumns(out)


def excess_returns(labels: DataFrame, bench: DataFrame, keys: Sequence[str], level: str, name: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """L3, L4. Forward returns minus those of a benchmark level, joined on keys (date, or sector and date).

    bench has keys and the column level; its own forward returns are taken along its dates.
    """
    order = Window.partitionBy(*[k for k in keys if k != "date"]).orderBy("date") if len(keys) > 1 else Window.partitionBy(F.lit(0)).orderBy("date")
    ahead = bench.select(*keys, *[(F.lead(level, h).over(order) / F.col(level) - 1).alias(f"_b{h}") for h in horizons])
    df = labels.join(ahead, list(keys), "left")
    return df.withColumns({f"excess_vs_{name}_{h}d": F.col(f"forward_return_{h}d") - F.col(f"_b{h}") for h in horizons}).drop(*[f"_b{h}" for h in horizons])


def first_touch(profit: float = PROFIT, stop: float = STOP, hold: int = HOLD) -> Column:
    """1 if a later high reaches the profit level first, -1 if a low reaches the stop, 0 if neither; profit wins within a bar."""
    c = F.col("close")
    out = F.lit(None).cast("int")
    touches = []
    for k in range(1, hold + 1):
        touches.append(F.when(lead("high", k) >= c * (1 + profit), 1).when(lead("low", k) <= c * (1 - stop), -1))
    out = F.coalesce(*touches, F.lit(0))
    return F.when(c > 0, out)


def triple_barrier(panel: DataFrame, profit: float = PROFIT, stop: float = STOP, hold: int = HOLD) -> DataFrame:
    """L5."""
    return panel.withColumn("triple_barrier", first_touch(profit, stop, hold))


def meta_label(panel: DataFrame, signal: str, profit: float = PROFIT, stop: float = STOP, hold: int = HOLD) -> DataFrame:
    """L8. For bars with the signal 1 if profit comes before the stop, else 0; NULL elsewhere; status BLOCKED_NO_SIGNALS if there are none at all."""
    label = F.when(F.col(signal), F.when(first_touch(profit, stop, hold) == 1, 1).otherwise(0))
    n = panel.agg(F.count_if(F.col(signal)).alias("_n")).select(F.when(F.col("_n") > 0, "OK").otherwise("BLOCKED_NO_SIGNALS").alias("meta_status"))
    return panel.withColumn("meta_label", label).join(F.broadcast(n))


def cross_sectional_ranks(labels: DataFrame, horizons: Sequence[int] = HORIZONS, least: int = LEAST_SYMBOLS) -> DataFrame:
    """L6, L7. Percentile rank of the forward return among the date's symbols, if there are enough, and its top and bottom tenth."""
    out, flags = {}, {}
    for h in horizons:
        x = F.col(f"forward_return_{h}d")
        have = x.isNotNull()
        # missing returns form a part of their own, so that they don't enter the ranks
        w = Window.partitionBy("date", have)
        rank = F.percent_rank().over(w.orderBy(x))
        out[f"forward_rank_{h}d"] = F.when(have & (F.count(F.lit(1)).over(w) >= least), rank)
        flags[f"top_decile_{h}d"] = (F.col(f"forward_rank_{h}d") >= 0.9).cast("int")
        flags[f"bottom_decile_{h}d"] = (F.col(f"forward_rank_{h}d") <= 0.1).cast("int")
    return labels.withColumns(out).withColumns(flags)


def long_form(df: DataFrame, names: Sequence[str], key: str, value: str, ids: Sequence[str] = ("symbol", "date")) -> DataFrame:
    return df.select(*ids, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(list(ids), list(names), key, value)


def validate(labels: DataFrame, names: Sequence[str], most_missing: float = 0.30) -> DataFrame:
    """L9. Per label: rows, missing, infinite, the missing rate and whether it passes."""
    x = F.col("value")
    df = long_form(labels, names, "label", "value").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("n_nan"), F.count_if(F.abs(x) == float("inf")).alias("n_inf"))
    return df.withColumn("nan_rate", F.col("n_nan") / F.col("n")).withColumn("passed", F.col("nan_rate") < most_missing)


def path_excursion(panel: DataFrame, hold: int = HOLD) -> DataFrame:
    """L10. Worst and best move over the next hold bars and the bar at which the best comes; NULL where fewer bars follow."""
    w = by_symbol().rowsBetween(1, hold)
    full = F.count(F.lit(1)).over(w) == hold
    c = F.col("close")
    best = F.max_by("i", F.struct("high", (-F.col("i")).alias("early"))).over(w)
    return panel.withColumns({"mae": F.when(full, F.min("low").over(w) / c - 1), "mfe": F.when(full, F.max("high").over(w) / c - 1), "time_to_mfe": F.when(full, best - F.col("i"))})


def excursion_report(paths: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    df = paths.filter("mae IS NOT NULL").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("mae").alias("mean_mae"), F.percentile("mae", 0.5).alias("median_mae"), F.avg("mfe").alias("mean_mfe"), F.percentile("mfe", 0.5).alias("median_mfe"), F.avg("time_to_mfe").alias("mean_time_to_mfe"), F.avg((F.col("mae") <= -STOP).cast("double")).alias("stop_hit_rate"),
    )
    return df.withColumn("mae_mfe_ratio", F.try_divide(F.abs("mean_mae"), F.col("mean_mfe")))


def first_passages(panel: DataFrame, stop: Column, target: Column, horizon: int = 60) -> DataFrame:
    """L10. panel with the stop and the target of a position opened at each bar's close, and how many bars later a low first reaches the one and a high the other.

    Levels are any of the bar's columns, such as the close less a multiple of the ATR;
    bars to either are null if the next horizon bars don't reach it. hit is 'stop' where
    the stop comes first or both in one bar, 'profit' where the target does, 'none', or
    null where a level is missing or the history ends before the horizon and either.
    """
    df = panel.withColumns({"stop_level": stop.cast("double"), "target_level": target.cast("double")})
    df = orders.added(df, {
        "bars_to_stop": lambda f: orders.first_at_most(orders.numbers(f, "low"), orders.numbers(f, "stop_level"), horizon),
        "bars_to_profit": lambda f: orders.first_at_least(orders.numbers(f, "high"), orders.numbers(f, "target_level"), horizon),
        "_left": lambda f: np.arange(len(f), 0, -1) - 1,
    })
    s, p = F.col("bars_to_stop"), F.col("bars_to_profit")
    hit = F.when(s <= F.coalesce(p, s), "stop").when(p.isNotNull(), "profit").when((F.col("_left") >= horizon), "none")
    return df.withColumn("hit", F.when(F.col("stop_level").isNotNull() & F.col("target_level").isNotNull(), hit)).drop("_left")


def passage_report(passages: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """L10. For each group: positions with an outcome, the shares stopped and in profit first, and the mean and median bars to a profit that came first."""
    won = F.when(F.col("hit") == "profit", F.col("bars_to_profit"))
    share = lambda k: F.avg((F.col("hit") == k).cast("double"))
    return passages.filter("hit IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share("stop").alias("stop_hit_rate"), share("profit").alias("profit_rate"), F.avg(won).alias("mean_bars_to_profit"), F.percentile(won, 0.5).alias("median_bars_to_profit"))
