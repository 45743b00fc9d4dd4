"""Registered feature queries (W1-W60): each family over all bars, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel.functions.windows import fixed
from qpanel.operators import microstructure, regime, residual, spec, statistical, technical
from qpanel.sources.bars import bars_from_lines, panel

from . import sql
from .sql import BARS, BENCH, W, at, mean0, r, ratio

FAMILIES = {"technical": technical, "statistical": statistical, "regime": regime, "residual": residual, "microstructure": microstructure}


def every_spec() -> list[spec.FeatureSpec]:
    seen = {}
    for f in FAMILIES.values():
        for s in f.specs():
            seen.setdefault(s.name, s)
    return list(seen.values())


def feature_names() -> list[str]:
    return [s.name for s in every_spec() if not s.name.startswith("_")]


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(bars_from_lines(spark, sf_dir))


def joined_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars with their benchmarks."""
    return residual.with_own_benchmark(sample(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """The named features of all bars; benchmarks are joined only if a residual feature is asked for."""
    df = sample(spark, sf_dir)
    if any(n.startswith("residual_") or n == "cumulative_residual" for n in names):
        df = residual.with_own_benchmark(df)
    return spec.compute(df, every_spec(), names)


def places(name: str, digits: int) -> int:
    """Decimals shown: price impact per unit of turnover is tiny."""
    return 10 if name.startswith(("amihud", "kyles")) else digits


def family(names: list[str], digits: int | None = 6, exact: tuple[str, ...] = ()):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = features(spark, sf_dir, [n for n in names if n != "residual_status"])
        return df.select("symbol", "date", *[F.col(n) if n in exact or digits is None else fixed(n, places(n, digits)).alias(n) for n in names])

    return query


def stated(steps: list[dict[str, str]], names: list[str], digits: int | None = 6, exact: tuple[str, ...] = (), extra: str = "") -> str:
    """SQL with one CTE for each step of columns over the panel."""
    ctes, before = [BARS + extra], "panel"
    for k, columns in enumerate(steps):
        ctes.append(f"s{k} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM {before} {W})")
        before = f"s{k}"
    shown = ", ".join(["symbol", "date", *[n if n in exact or digits is None else f"{sql.fixed(n, places(n, digits))} AS {n}" for n in names]])
    return f"WITH {', '.join(ctes)} SELECT {shown} FROM {before}"


WINDOWS, STAT = (5, 10, 20, 50, 200), (5, 10, 20, 50, 100)
QUERIES, SQL = {}, {}


def register(name: str, names: list[str], steps: list[dict[str, str]], digits: int | None = 6, exact: tuple[str, ...] = (), extra: str = "") -> None:
    QUERIES[name] = family(names, digits, exact)
    SQL[name] = stated(steps, names, digits, exact, extra)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER w"


# Means, distances, slopes
register(
    "w1_w6_moving_averages",
    [f"{p}" for w in WINDOWS for p in (f"sma_{w}", f"dist_sma_{w}", f"sma_{w}_slope")],
    [{f"sma_{w}": mean0("close", w) for w in WINDOWS}, {k: x for w in WINDOWS for k, x in ((f"dist_sma_{w}", ratio(f"close - sma_{w}", f"sma_{w}")), (f"sma_{w}_slope", ratio(f"sma_{w} - {lag(f'sma_{w}', 5)}", lag(f"sma_{w}", 5))))}],
)
# W2, W10, W12
register(
    "w10_w12_bands_volume",
    ["bb_upper", "bb_lower", "bb_width", "bb_position", *[f"{p}_{w}" for w in WINDOWS for p in ("vol_ma", "rvol")]],
    [
        {"m": mean0("close", 20), "d": at(20, f"stddev_pop(close) OVER {r(20)}"), **{f"vol_ma_{w}": mean0("volume", w) for w in WINDOWS}},
        {"bb_upper": "m + 2.0 * d", "bb_lower": "m - 2.0 * d", **{f"rvol_{w}": ratio("volume", f"vol_ma_{w}") for w in WINDOWS}},
        {"bb_width": ratio("bb_upper - bb_lower", "m"), "bb_position": ratio("close - bb_lower", "bb_upper - bb_lower")},
    ],
)
# W3, W14, W15
register(
    "w14_w15_channels",
    ["swing_low_5d", "swing_high_5d", *[f"donchian_{p}_{w}" for w in (20, 50) for p in ("high", "low", "pos")]],
    [
        {"swing_low_5d": at(5, f"min(low) OVER {r(5)}"), "swing_high_5d": at(5, f"max(high) OVER {r(5)}"), **{f"donchian_high_{w}": at(w, f"max(high) OVER {r(w)}") for w in (20, 50)}, **{f"donchian_low_{w}": at(w, f"min(low) OVER {r(w)}") for w in (20, 50)}},
        {f"donchian_pos_{w}": ratio(f"close - donchian_low_{w}", f"donchian_high_{w} - donchian_low_{w}") for w in (20, 50)},
    ],
    digits=None,
)
# W17-W19
register(
    "w17_w19_momentum_volatility",
    [f"{p}" for w in STAT for p in (f"mom_{w}d", f"mom_sma_{w}", f"vol_{w}d")],
    [
        {**{f"mean_{w}": mean0("close", w) for w in STAT}, **{f"mom_{w}d": f"CASE WHEN {lag('close', w)} > 0 THEN close / {lag('close', w)} - 1 END" for w in STAT}, **{f"vol_{w}d": at(w + 1, f"stddev_pop(returns) OVER {r(w)}") for w in STAT}},
        {f"mom_sma_{w}": f"CASE WHEN {lag(f'mean_{w}', 5)} > 0 THEN mean_{w} / {lag(f'mean_{w}', 5)} - 1 END" for w in STAT},
    ],
)
# W20-W22, W27, W28
register(
    "w20_w28_scores_drawdown",
    ["zscore_20d", "zscore_50d", "dd_20d", "dd_100d", "range_20d", "range_100d", "daily_gap", "eff_ratio_10d", "eff_ratio_20d"],
    [
        {**{f"m{w}": mean0("close", w) for w in (20, 50)}, **{f"d{w}": at(w, f"stddev_pop(close) OVER {r(w)}") for w in (20, 50)}, **{f"hi{w}": at(w, f"max(close) OVER {r(w)}") for w in (20, 100)}, **{f"lo{w}": at(w, f"min(close) OVER {r(w)}") for w in (20, 100)}, "daily_gap": f"CASE WHEN {lag('close')} > 0 THEN close / {lag('close')} - 1 END", "moved": f"abs(close - {lag('close')})"},
        {**{f"zscore_{w}d": ratio(f"close - m{w}", f"d{w}") for w in (20, 50)}, **{f"dd_{w}d": ratio(f"close - hi{w}", f"hi{w}") for w in (20, 100)}, **{f"range_{w}d": ratio(f"hi{w} - lo{w}", f"lo{w}") for w in (20, 100)}, **{f"eff_ratio_{w}d": at(w + 1, f"CASE WHEN sum(moved) OVER {r(w)} > 0 THEN abs(close - {lag('close', w)}) / (sum(moved) OVER {r(w)}) END") for w in (10, 20)}},
    ],
)
# Moments from centred sums, so that both engines see the same numbers
register(
    "w23_w26_moments_correlation",
    ["skew_20d", "skew_50d", "kurtosis_20d", "kurtosis_50d", "pv_corr_20d", "pv_corr_50d"],
    [
        {f"v{w}": f"list(returns) OVER {r(w)}" for w in (20, 50)} | {f"sp{w}": f"(stddev_pop(close) OVER {r(w)}) * (stddev_pop(volume) OVER {r(w)})" for w in (20, 50)} | {f"cv{w}": f"covar_pop(close, volume) OVER {r(w)}" for w in (20, 50)},
        {f"u{w}": f"list_avg(v{w})" for w in (20, 50)},
        {f"s{w}": f"list_avg(list_transform(v{w}, lambda q: (q - u{w}) * (q - u{w})))" for w in (20, 50)},
        {**{f"skew_{w}d": at(w + 1, f"CASE WHEN s{w} > 0 THEN list_avg(list_transform(v{w}, lambda q: (q - u{w}) * (q - u{w}) * (q - u{w}))) / (s{w} * sqrt(s{w})) END") for w in (20, 50)}, **{f"kurtosis_{w}d": at(w + 1, f"CASE WHEN s{w} > 0 THEN list_avg(list_transform(v{w}, lambda q: (q - u{w}) * (q - u{w}) * (q - u{w}) * (q - u{w}))) / (s{w} * s{w}) END") for w in (20, 50)}, **{f"pv_corr_{w}d": at(w + 1, f"CASE WHEN sp{w} > 0 THEN cv{w} / sp{w} END") for w in (20, 50)}},
    ],
)
# runs
QUERIES["w25_runs"] = family(["consec_up", "consec_down"], None)
SQL["w25_runs"] = f"""WITH {BARS}, g AS (
  SELECT *, sum(CASE WHEN i > 1 AND returns > 0 THEN 0 ELSE 1 END) OVER w AS gu, sum(CASE WHEN i > 1 AND returns < 0 THEN 0 ELSE 1 END) OVER w AS gd FROM panel {W})
SELECT symbol, date, CAST(row_number() OVER (PARTITION BY symbol, gu ORDER BY date) - 1 AS DOUBLE) AS consec_up,
       CAST(row_number() OVER (PARTITION BY symbol, gd ORDER BY date) - 1 AS DOUBLE) AS consec_down FROM g"""
# W29-W34, W36, W37
register(
    "w29_w37_regime",
    ["sma20_50_alignment", "trend_strength", "regime_score", "vol_regime", "breadth_sma20", "hh_ll_20d", "vol_expansion", "dist_52w_high", "dist_52w_low"],
    [
        {**{f"m{w}": mean0("close", w) for w in (20, 50, 200)}, "v20": at(21, f"stddev_pop(returns) OVER {r(20)}")},
        {
            "sma20_50_alignment": "CASE WHEN m20 IS NOT NULL AND m50 IS NOT NULL THEN CASE WHEN close > m20 AND m20 > m50 THEN 3.0 WHEN close > m20 AND close > m50 THEN 2.0 WHEN close > m50 THEN 1.0 ELSE 0.0 END::DOUBLE END",
            "trend_strength": ratio(f"m50 - {lag('m50', 10)}", lag("m50", 10)),
            "regime_score": "CASE WHEN m50 IS NOT NULL AND m200 IS NOT NULL AND v20 IS NOT NULL THEN ((close > m50)::INT + (close > m200)::INT + (v20 < 0.025)::INT)::DOUBLE END",
            "vol_regime": "CASE WHEN v20 < 0.01 THEN 'low' WHEN v20 < 0.025 THEN 'normal' WHEN v20 < 0.04 THEN 'high' WHEN v20 IS NOT NULL THEN 'crash' END",
            "above": "CASE WHEN close > m20 THEN 1.0 ELSE 0.0 END::DOUBLE",
            "hh_ll_20d": at(21, "(CASE WHEN high > max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) THEN 1.0 ELSE 0.0 END - CASE WHEN low < min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) THEN 1.0 ELSE 0.0 END)::DOUBLE"),
            "vol_expansion": at(81, f"CASE WHEN avg(v20) OVER {r(61)} > 0 THEN v20 / (avg(v20) OVER {r(61)}) END"),
            "dist_52w_high": ratio("close", at(253, f"max(high) OVER {r(253)}")),
            "dist_52w_low": ratio("close", at(253, f"min(low) OVER {r(253)}")),
        },
        {"breadth_sma20": at(10, f"sum(above) OVER {r(10)}")},
    ],
    exact=("vol_regime", "sma20_50_alignment", "regime_score", "hh_ll_20d", "breadth_sma20"),
)
# J1, W41-W45
register(
    "j1_w41_w45_residual",
    ["residual_beta", "residual_alpha", "residual_r2", "cumulative_residual", "residual_z", "residual_return", "residual_status"],
    [
        {"n": f"regr_count(returns, bench_return) OVER {r(60)}", "ve": f"var_pop(bench_return) OVER {r(60)}", "vs0": f"var_pop(returns) OVER {r(60)}", "cov": f"covar_pop(returns, bench_return) OVER {r(60)}", "ms": f"avg(returns) OVER {r(60)}", "me": f"avg(bench_return) OVER {r(60)}", "s20": f"sum(returns) OVER {r(20)}", "e20": f"sum(bench_return) OVER {r(20)}"},
        {"residual_beta": at(61, "CASE WHEN n >= 20 AND ve > 0 THEN cov / ve END"), "vs": at(61, "CASE WHEN n >= 20 AND ve > 0 THEN vs0 END")},
        {"residual_alpha": "ms - residual_beta * me", "residual_r2": "CASE WHEN vs = 0 THEN 0.0 ELSE residual_beta * cov / vs END"},
        {"cumulative_residual": "s20 - 20 * residual_alpha - residual_beta * e20", "residual_return": "returns - (residual_alpha + residual_beta * bench_return)", "spread": "sqrt(vs * greatest(0, 1 - residual_r2))"},
        {"residual_z": "CASE WHEN spread > 0 THEN cumulative_residual / (spread * sqrt(20.0)) WHEN spread IS NOT NULL THEN 0.0 END"},
    ],
    exact=("residual_status",),
    extra=f", {BENCH}, panel0 AS (SELECT * FROM panel), panel1 AS (SELECT panel0.*, coalesce(sector_return, market_return) AS bench_return, CASE WHEN sector_return IS NOT NULL THEN 'SECTOR' WHEN market_return IS NOT NULL THEN 'MARKET' ELSE 'BLOCKED_NO_BENCHMARK' END AS residual_status FROM panel0 LEFT JOIN sectors USING (symbol) LEFT JOIN sector_bench USING (sector, date) LEFT JOIN market_bench USING (date))",
)
SQL["j1_w41_w45_residual"] = SQL["j1_w41_w45_residual"].replace("FROM panel WINDOW", "FROM panel1 WINDOW", 1)
# W49-W60
register(
    "w49_w60_microstructure",
    ["signed_volume", "cum_signed_volume", "ofi_5d", "ofi_10d", "ofi_20d", "vwap_proxy", "vwap_deviation", "spread_proxy", "spread_proxy_ma20", "close_location", "amihud_illiquidity", "amihud_ma20", "volume_climax", "intraday_range_pct", "up_down_vol_ratio", "kyles_lambda", "downward_pressure"],
    [
        {"prev": lag("close"), "signed_volume": f"volume * sign(close - {lag('close')})", "typical": "(high + low + close) / 3", "spread_proxy": ratio("high - low", "close"), "close_location": ratio("close - low", "high - low"), "amihud_illiquidity": ratio("abs(returns)", "volume * close"), "vm20": mean0("volume", 20), "up": "CASE WHEN returns > 0 THEN volume ELSE 0.0 END", "down": "CASE WHEN returns < 0 THEN volume ELSE 0.0 END"},
        {"cum_signed_volume": "sum(coalesce(signed_volume, 0)) OVER (w ROWS UNBOUNDED PRECEDING)", **{f"ofi_{w}d": ratio(mean0("signed_volume", w), mean0("volume", w)) for w in (5, 10, 20)}, "vwap_proxy": ratio("sum(typical * volume) OVER (w ROWS UNBOUNDED PRECEDING)", "sum(volume) OVER (w ROWS UNBOUNDED PRECEDING)"), "spread_proxy_ma20": mean0("spread_proxy", 20), "amihud_ma20": mean0("amihud_illiquidity", 20), "volume_climax": ratio("volume", "vm20"), "intraday_range_pct": ratio("high - low", "close"), "up_down_vol_ratio": ratio(mean0("up", 10), mean0("down", 10)), "kyles_lambda": at(21, f"CASE WHEN count(CASE WHEN volume * close > 0 THEN 1 END) OVER {r(20)} > 5 THEN avg(CASE WHEN volume * close > 0 THEN abs(returns) / (volume * close) END) OVER {r(20)} END"), "downward_pressure": "CASE WHEN vm20 IS NOT NULL THEN (close < prev AND volume > vm20)::INT::DOUBLE END"},
        {"vwap_deviation": ratio("close - vwap_proxy", "vwap_proxy")},
    ],
    exact=("signed_volume", "cum_signed_volume", "downward_pressure"),
)
# Recursions; the tests hold them against plain loops
KERNEL_NAMES = ["ema_10", "ema_20", "ema_cross", "rsi_2", "rsi_7", "rsi_14", "atr_7", "atr_14", "atr_7_pct", "atr_14_pct", "macd", "macd_signal", "macd_histogram", "hurst_100", "adx_proxy_14", "residual_half_life"]


def recursive_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir, KERNEL_NAMES).select("symbol", "date", *KERNEL_NAMES)


QUERIES["w7_w46_recursive_features"] = recursive_features

# the recursion that SQL can state in reasonable time: Wilder's and exponential means as weighted sums of all earlier rows
QUERIES["w7_ema"] = family(["ema_10", "ema_20", "ema_cross"])
SQL["w7_ema"] = f"""WITH RECURSIVE {BARS}, seeds AS (
  SELECT symbol, avg(close) FILTER (i <= 10) AS s10, avg(close) FILTER (i <= 20) AS s20 FROM panel GROUP BY symbol
), walk(symbol, i, e10, e20) AS (
  SELECT p.symbol, CAST(10 AS BIGINT), s10, CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT symbol FROM panel) p JOIN seeds USING (symbol)
  UNION ALL
  SELECT p.symbol, p.i, 2.0::DOUBLE / 11 * p.close + (1 - 2.0::DOUBLE / 11) * walk.e10,
         CASE WHEN p.i = 20 THEN s.s20 WHEN p.i > 20 THEN 2.0::DOUBLE / 21 * p.close + (1 - 2.0::DOUBLE / 21) * walk.e20 END
  FROM walk JOIN panel p ON p.symbol = walk.symbol AND p.i = walk.i + 1 JOIN seeds s ON s.symbol = p.symbol
)
SELECT p.symbol, p.date, {sql.fixed('e10')} AS ema_10, {sql.fixed('e20')} AS ema_20, {sql.fixed('CASE WHEN e20 > 0 THEN (e10 - e20) / e20 END')} AS ema_cross
FROM panel p LEFT JOIN walk ON walk.symbol = p.symbol AND walk.i = p.i"""


# Wilder's means and the second exponential mean, step by step as the kernels take them
def wilder_seed(x: str, n: int) -> str:
    return f"avg({x}) FILTER (i BETWEEN 2 AND {n + 1})"


def wilder_step(state: str, x: str, n: int) -> str:
    return f"CASE WHEN p.i = {n + 1} THEN s.{state} WHEN p.i > {n + 1} THEN walk.{state} + (p.{x} - walk.{state}) / {n} END"


WILDER = {f"u{n}": ("up", n) for n in (2, 7, 14)} | {f"d{n}": ("down", n) for n in (2, 7, 14)} | {f"a{n}": ("tr", n) for n in (7, 14)}
QUERIES["w9_w11_rsi_atr"] = family(["rsi_2", "rsi_7", "rsi_14", "atr_7", "atr_14", "atr_7_pct", "atr_14_pct"], 4)
SQL["w9_w11_rsi_atr"] = f"""WITH RECURSIVE {BARS}, steps AS (
  SELECT *, greatest(close - lag(close, 1, close) OVER w, 0) AS up, greatest(lag(close, 1, close) OVER w - close, 0) AS down,
         CASE WHEN i = 1 THEN 0 ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM panel {sql.W}
), seeds AS (SELECT symbol, {', '.join(f"{wilder_seed(x, n)} AS {k}" for k, (x, n) in WILDER.items())} FROM steps GROUP BY symbol
), walk(symbol, i, {', '.join(WILDER)}) AS (
  SELECT symbol, CAST(2 AS BIGINT), {', '.join('CAST(NULL AS DOUBLE)' for _ in WILDER)} FROM seeds
  UNION ALL
  SELECT p.symbol, p.i, {', '.join(wilder_step(k, x, n) for k, (x, n) in WILDER.items())}
  FROM walk JOIN steps p ON p.symbol = walk.symbol AND p.i = walk.i + 1 JOIN seeds s ON s.symbol = p.symbol
)
SELECT p.symbol, p.date, {', '.join(f"{sql.fixed(f'CASE WHEN d{n} = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + u{n} / d{n}) END', 4)} AS rsi_{n}" for n in (2, 7, 14))},
       {', '.join(f"{sql.fixed(f'a{n}', 4)} AS atr_{n}, {sql.fixed(f'CASE WHEN close > 0 THEN a{n} / close END', 4)} AS atr_{n}_pct" for n in (7, 14))}
FROM panel p LEFT JOIN walk ON walk.symbol = p.symbol AND walk.i = p.i"""

QUERIES["w13_macd"] = family(["macd", "macd_signal", "macd_histogram"], 4)
SQL["w13_macd"] = f"""WITH RECURSIVE {BARS}, seeds AS (
  SELECT symbol, avg(close) FILTER (i <= 12) AS e12, avg(close) FILTER (i <= 26) AS e26 FROM panel GROUP BY symbol
), walk(symbol, i, e12, e26) AS (
  SELECT symbol, CAST(12 AS BIGINT), e12, CAST(NULL AS DOUBLE) FROM seeds
  UNION ALL
  SELECT p.symbol, p.i, 2.0::DOUBLE / 13 * p.close + (1 - 2.0::DOUBLE / 13) * walk.e12,
         CASE WHEN p.i = 26 THEN s.e26 WHEN p.i > 26 THEN 2.0::DOUBLE / 27 * p.close + (1 - 2.0::DOUBLE / 27) * walk.e26 END
  FROM walk JOIN panel p ON p.symbol = walk.symbol AND p.i = walk.i + 1 JOIN seeds s ON s.symbol = p.symbol
), lines AS (SELECT symbol, i, e12 - e26 AS m FROM walk WHERE e26 IS NOT NULL
), signal(symbol, i, v) AS (
  SELECT symbol, CAST(34 AS BIGINT), avg(m) FILTER (i <= 34) FROM lines GROUP BY symbol
  UNION ALL
  SELECT l.symbol, l.i, 2.0::DOUBLE / 10 * l.m + (1 - 2.0::DOUBLE / 10) * signal.v FROM signal JOIN lines l ON l.symbol = signal.symbol AND l.i = signal.i + 1
)
SELECT p.symbol, p.date, {sql.fixed('m', 4)} AS macd, {sql.fixed('v', 4)} AS macd_signal, {sql.fixed('m - v', 4)} AS macd_histogram
FROM panel p LEFT JOIN lines ON lines.symbol = p.symbol AND lines.i = p.i LEFT JOIN signal ON signal.symbol = p.symbol AND signal.i = p.i"""


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 117 features of all bars."""
    names = feature_names()
    return features(spark, sf_dir, names).select("symbol", "date", *names)


QUERIES["full_feature_panel"] = full_panel
