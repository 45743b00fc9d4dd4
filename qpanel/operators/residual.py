"""Benchmark joins and residual features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qpanel.functions.windows import from_bar, trailing

from .spec import FeatureSpec

CATEGORY = "residual"
WINDOW, LEAST, CUMULATED = 60, 20, 20
FIT_CUTS = ((0.35, "GOOD"), (0.20, "ACCEPTABLE"), (0.10, "LOW"))
LOW_CONFIDENCE = 0.2


def sector_of(symbol: Column) -> Column:
    """A sector for symbols that end in a number."""
    return (F.regexp_extract(symbol, "([0-9]+)", 1).cast("int") % 5).cast("string")


def benchmarks(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean return of each (sector, date) and of each date: hash aggregates, combined within map tasks."""
    sector = bars.groupBy(sector_of(F.col("symbol")).alias("sector"), "date").agg(F.avg("returns").alias("sector_return"))
    market = bars.groupBy("date").agg(F.avg("returns").alias("market_return"))
    return sector, market


def with_benchmark(bars: DataFrame, sector_map: DataFrame, bench: DataFrame, market: DataFrame) -> DataFrame:
    """J1. bars with their sector's benchmark return, else the market's, and where it came from.

    sector_map(symbol, sector), bench(sector, date, sector_return), market(date, market_return).
    Joined by date, never by position. Catalyst broadcasts the small sides when they are small.
    """
    df = bars.join(sector_map, "symbol", "left").join(bench, ["sector", "date"], "left").join(market, "date", "left")
    source = F.when(F.col("sector_return").isNotNull(), "SECTOR").when(F.col("market_return").isNotNull(), "MARKET").otherwise("BLOCKED_NO_BENCHMARK")
    return df.withColumns({"bench_return": F.coalesce("sector_return", "market_return"), "residual_status": source})


def with_own_benchmark(bars: DataFrame) -> DataFrame:
    sector, market = benchmarks(bars)
    return with_benchmark(bars, bars.select("symbol").distinct().withColumn("sector", sector_of(F.col("symbol"))), sector, market)


def specs() -> list[FeatureSpec]:
    """One rolling regression of returns on bench_return over WINDOW rows with at least LEAST pairs, from row WINDOW + 1."""
    s, e = F.col("returns"), F.col("bench_return")
    w, k = trailing(WINDOW), trailing(CUMULATED)
    pair = s.isNotNull() & e.isNotNull()
    sp, ep = F.when(pair, s), F.when(pair, e)
    out: list[FeatureSpec] = []

    def add(name, column=None, needs=()):
        out.append(FeatureSpec(name, CATEGORY, WINDOW + 1, column, tuple(needs), ("returns", "bench_return")))

    def fit(x: Column) -> Column:
        return from_bar(F.when((F.count(ep).over(w) >= LEAST) & (F.var_pop(ep).over(w) > 0), x), WINDOW + 1)

    a, b, r2, cum = (F.col(f"residual_{x}") for x in ("alpha", "beta", "r2", "cumulative"))
    cum = F.col("cumulative_residual")
    add("residual_beta", fit(F.regr_slope(s, e).over(w)))
    add("residual_alpha", fit(F.regr_intercept(s, e).over(w)))
    add("_var_s", fit(F.var_pop(sp).over(w)))
    add("residual_r2", F.when(F.col("_var_s") == 0, 0.0).otherwise(fit(F.coalesce(F.regr_r2(s, e).over(w), F.lit(0.0)))), ["_var_s"])
    add("cumulative_residual", F.sum(sp).over(k) - F.count(sp).over(k) * a - b * F.sum(ep).over(k), ["residual_alpha", "residual_beta"])
    spread = F.sqrt(F.col("_var_s") * F.greatest(F.lit(0.0), 1 - r2))
    # the regression's residuals have mean 0 over the window
    z = F.when(spread > 0, cum / (spread * F.sqrt(F.count(sp).over(k).cast("double")))).when(spread.isNotNull(), 0.0)
    add("residual_z", z, ["cumulative_residual", "_var_s", "residual_r2"])
    add("residual_return", s - (a + b * e), ["residual_alpha", "residual_beta"])
    add("residual_half_life")
    return out


def fit_quality(features: DataFrame) -> DataFrame:
    """W47. Class of each symbol's fit from the median of its r2, with mean beta and median half-life."""
    df = features.groupBy("symbol").agg(
        F.percentile("residual_r2", 0.5).alias("median_r2"), F.avg("residual_beta").alias("mean_beta"),
        F.percentile(F.when(F.col("residual_half_life") != float("inf"), F.col("residual_half_life")), 0.5).alias("median_half_life"),
        F.avg((F.col("residual_r2") < LOW_CONFIDENCE).cast("double")).alias("low_confidence_share"),
    )
    fit = F.when(F.col("median_r2") >= FIT_CUTS[0][0], FIT_CUTS[0][1])
    for cut, name in FIT_CUTS[1:]:
        fit = fit.when(F.col("median_r2") >= cut, name)
    return df.withColumn("fit", fit.otherwise("BLOCKED"))
