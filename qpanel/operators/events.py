"""Event studies, costs and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qpanel.functions.windows import trailing
from qpanel.sources.tables import settled

from .quantiles import quantiles

#: Rebalances per year by horizon, and basis points of a trade. Fixed values.
REBALANCES = {1: 252, 3: 84, 5: 50, 10: 25, 20: 12}
COSTS = (10, 5, 2)
LEAST_EVENTS = 50


def residual_signals(features: DataFrame) -> DataFrame:
    """V16. Residual reversion signals at three depths, with fit, half-life and regime limits: one row per bar and variant met."""
    ok = (F.col("residual_r2") >= 0.2) & F.col("residual_half_life").between(2, 30) & (F.col("regime_score") <= 2)
    variants = F.array_compact(F.array(*[F.when(ok & (F.col("residual_z") <= z), n) for n, z in (("z_1_5", -1.5), ("z_2_0", -2.0), ("z_2_5", -2.5))]))
    return features.select("*", F.explode(variants).alias("variant"))


def base_signals(features: DataFrame) -> DataFrame:
    """V17. Strategies' own signals: oversold RSI(2), and a mean-reverting Hurst exponent outside strong trends."""
    found = F.array_compact(F.array(F.when(F.col("rsi_2") < 30, "mean_reversion"), F.when((F.col("hurst_100") < 0.45) & (F.col("regime_score") <= 1), "structural_mr")))
    return features.select("*", F.explode(found).alias("strategy"))


def pullback_features(panel: DataFrame, fast: int = 5, slow: int = 20, window: int = 10) -> DataFrame:
    """W66. Fast and slow means over full windows, pullback from the window's highest close, trend flag."""
    full = lambda n, x: F.when(F.col("i") >= n, x)
    df = panel.withColumns({"fast_ma": full(fast, F.avg("close").over(trailing(fast))), "slow_ma": full(slow, F.avg("close").over(trailing(slow))), "pullback": full(window, F.col("close") / F.max("close").over(trailing(window)) - 1)})
    return df.withColumn("trend_positive", F.coalesce(F.col("fast_ma") > F.col("slow_ma"), F.lit(False)))


def latest_signals(features: DataFrame, least: float = 0.4) -> DataFrame:
    """V17, O3. Score and reasons of each symbol's latest bar."""
    last = features.groupBy("symbol").agg(F.max_by(F.struct("date", "fast_ma", "slow_ma", "pullback", "trend_positive"), "date").alias("r")).select("symbol", "r.*").filter("fast_ma IS NOT NULL AND slow_ma IS NOT NULL")
    score = F.when(F.col("trend_positive"), 0.3).otherwise(0.0) + F.when(F.col("pullback") < -0.01, 0.2).otherwise(0.0)
    reasons = F.array_compact(F.array(F.when(F.col("trend_positive"), "trend_positive"), F.when(F.col("pullback") < -0.01, "short_pullback")))
    return last.withColumns({"score": score, "direction": F.when(score >= least, "long").otherwise("flat"), "reason_codes": reasons})


def event_stats(df: DataFrame, by: Sequence[str], x: str = "ret") -> DataFrame:
    """Count, mean, median and hit rate of each group; the groups are few and may be large."""
    stats = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg((F.col(x) > 0).cast("double")).alias("hit_rate"))
    return stats.join(quantiles(df, by, x, [0.5]), list(by), "left").select(*by, "n", "mean", F.get("q", F.lit(0)).alias("median"), "hit_rate")


def event_study(signals: DataFrame, by: Sequence[str], horizons: Sequence[int] = (1, 3, 5, 10, 20), cost_bps: float = 10.0) -> DataFrame:
    """A19. For each signal variant and horizon: events, mean, median, hit rate, and the mean after a round trip's cost."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"forward_return_{h}d").alias("ret")) for h in horizons])
    df = signals.select(*by, F.explode(rows).alias("r")).select(*by, "r.*").filter("ret IS NOT NULL")
    return event_stats(settled(df), [*by, "horizon"]).withColumn("net_mean", F.col("mean") - cost_bps / 1e4)


def horizon_costs(spreads: DataFrame, spark: SparkSession) -> DataFrame:
    """A20. spreads(horizon, spread_bps) at each cost mode: annual cost, what is left of the spread, and whether it survives one trade's cost."""
    modes = spark.createDataFrame([(h, n, c) for h, n in REBALANCES.items() for c in COSTS], "horizon int, rebalances int, cost_bps int")
    df = spreads.join(F.broadcast(modes), "horizon")
    return df.withColumns({"annual_cost_bps": F.col("rebalances") * F.col("cost_bps"), "adjusted_bps": F.col("spread_bps") - F.col("rebalances") * F.col("cost_bps"), "survives": F.col("spread_bps") > F.col("cost_bps")})


def filter_test(signals: DataFrame, filters: dict[str, Column], by: Sequence[str] = ("strategy",), x: str = "ret") -> DataFrame:
    """A21, A22, V15. Every filter against the unfiltered signals, in one pass: counts, means, hits, trades given up, status."""
    aggregates = [F.count(x).alias("base_n"), F.avg(x).alias("base_mean"), F.avg((F.col(x) > 0).cast("double")).alias("base_hit")]
    for name, keep in filters.items():
        v = F.when(keep, F.col(x))
        aggregates += [F.struct(F.lit(name).alias("filter"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.avg(F.when(keep, (F.col(x) > 0).cast("double"))).alias("hit_rate")).alias(f"_{name}")]
    df = signals.groupBy(*by).agg(*aggregates)
    df = df.select(*by, "base_n", "base_mean", "base_hit", F.explode(F.array(*[F.col(f"_{n}") for n in filters])).alias("f")).select(*by, "base_n", "base_mean", "base_hit", "f.*")
    df = df.withColumns({"trade_reduction": 1 - F.col("n") / F.col("base_n"), "improvement": F.col("mean") - F.col("base_mean")})
    return df.withColumn("status", F.when(F.col("n") < LEAST_EVENTS, "BLOCKED_SMALL_SAMPLE").when(F.col("improvement") > 0, "IMPROVES").otherwise("NO_IMPROVEMENT"))


def segments(events: DataFrame, x: str = "ret") -> DataFrame:
    """A23, O9. Statistics by year, regime and sector in one pass over grouping sets."""
    df = events.groupingSets([["year"], ["regime"], ["sector"]], "year", "regime", "sector").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg((F.col(x) > 0).cast("double")).alias("hit_rate"), F.grouping_id("year", "regime", "sector").alias("_g"))
    kind = F.when(F.col("_g") == 3, "year").when(F.col("_g") == 5, "regime").otherwise("sector")
    value = F.when(F.col("_g") == 3, F.col("year").cast("string")).when(F.col("_g") == 5, F.col("regime")).otherwise(F.col("sector"))
    return df.select(kind.alias("segment"), value.alias("value"), "n", "mean", "hit_rate", F.when(F.col("n") < LEAST_EVENTS, "BLOCKED_SMALL_SAMPLE").otherwise("OK").alias("status"))


def distribution(events: DataFrame, by: Sequence[str] = ("symbol",), x: str = "ret") -> DataFrame:
    """A24. Moments, profit factor, the share of the best tenth in all gains, and the worst hundredth."""
    cut = events.groupBy(*by).agg(F.percentile(x, 0.9).alias("_p90"))
    v = F.col(x)
    df = events.join(cut, list(by)).groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurtosis"),
        F.try_divide(F.sum(F.when(v > 0, v)), F.abs(F.sum(F.when(v < 0, v)))).alias("profit_factor"),
        F.try_divide(F.sum(F.when(v >= F.col("_p90"), v)), F.sum(F.when(v > 0, v))).alias("top_tenth_share"), F.percentile(x, 0.01).alias("worst_hundredth"),
    )
    return df


def concentration(ics: DataFrame, k: int = 3) -> DataFrame:
    """A25. Share of the k largest |IC| of a feature in the sum over symbols: ics(feature, symbol, ic)."""
    w = Window.partitionBy("feature")
    df = ics.filter("ic IS NOT NULL").withColumn("_r", F.row_number().over(w.orderBy(F.abs("ic").desc(), "symbol")))
    return df.groupBy("feature").agg(F.count(F.lit(1)).alias("n_symbols"), F.try_divide(F.sum(F.when(F.col("_r") <= k, F.abs("ic"))), F.sum(F.abs("ic"))).alias("top_share"), F.avg(F.abs("ic")).alias("mean_abs_ic"))


def by_fit_class(events: DataFrame, fits: DataFrame, x: str = "ret") -> DataFrame:
    """A26. Event statistics of each fit class and of all."""
    df = events.join(fits.select("symbol", "fit"), "symbol").select(F.explode(F.array("fit", F.lit("ALL"))).alias("fit"), x)
    return event_stats(settled(df), ["fit"], x)
