"""Registered queries of metrics (A27-A35), catalogue indicators (W38-W72), ledgers (B1-B11), sources (S1-S18), scalars (P1-P19) and sets (O1-O11), and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qpanel.functions import text
from qpanel.functions.windows import by_symbol, fixed, std
from qpanel.operators import catalogue, events, factors, fundamentals, ledger, metrics, regime, residual, spec
from qpanel.sources import bars as sources
from qpanel.sources import store
from qpanel.sources.bars import bars_from_lines, table
from qpanel.sources.tables import shared_root

from . import features as fq
from .features import every_spec, sample
from .labels_joins import OBSERVED, observations
from .scores import FEATS, scored_input
from .sql import BARS, BENCH, W, at, mean0, r, ratio
from .sql import fixed as fx

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# metrics: a symbol's close is its equity
RET = f"{BARS}, eq AS (SELECT symbol, date, close AS equity, CASE WHEN lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END AS ret, close / (max(close) OVER (w ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM panel {W})"


@query("a27_metric_pack", f"WITH {RET}, g AS (SELECT symbol, count(ret) AS n_returns, arg_max(equity, date) / arg_min(equity, date) AS growth, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS dn, min(dd) AS max_drawdown, avg((dd < 0)::INT) AS tuw FROM eq GROUP BY symbol) SELECT symbol, n_returns, {fx('growth - 1')} AS total_return, {fx('pow(growth, 252 / n_returns) - 1')} AS cagr, {fx('sd * sqrt(252.0)', 5)} AS annualized_volatility, {fx('m / sd * sqrt(252.0)')} AS sharpe, {fx('m / dn * sqrt(252.0)', 5)} AS sortino, {fx('max_drawdown')} AS max_drawdown, {fx('tuw')} AS time_under_water FROM g")
def pack(spark, sf_dir):
    df = metrics.metric_pack(sample(spark, sf_dir).select("symbol", "date", F.col("close").alias("equity")), ["symbol"])
    return df.select("symbol", "n_returns", *[fixed(c, 5 if c in ("annualized_volatility", "sortino") else 6).alias(c) for c in df.columns[2:]])


TRADES = f"{FEATS}, trades AS (SELECT symbol, date, forward_return_5d AS pnl FROM feats WHERE mom_5d < 0 AND forward_return_5d IS NOT NULL)"


def trades(spark, sf_dir):
    return scored_input(spark, sf_dir, ["mom_5d"]).filter("mom_5d < 0 AND forward_return_5d IS NOT NULL").select("symbol", "date", F.col("forward_return_5d").alias("pnl"))


@query("a27_trade_metrics", f"WITH {TRADES} SELECT symbol, count(pnl) AS trade_count, {fx('sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0))')} AS profit_factor, {fx('avg(pnl)')} AS expectancy FROM trades GROUP BY symbol")
def trade_metrics(spark, sf_dir):
    return metrics.trade_metrics(trades(spark, sf_dir), ["symbol"]).withColumns({c: fixed(c) for c in ("profit_factor", "expectancy")})


@query("a28_weak_points", f"WITH {RET}, {TRADES.replace(BARS + ', ', '')}, g AS (SELECT symbol, avg(ret) / stddev_samp(ret) * sqrt(252.0) AS sharpe, min(dd) AS mdd, avg((dd < 0)::INT) AS tuw FROM eq GROUP BY symbol), t AS (SELECT symbol, sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0)) AS pf FROM trades GROUP BY symbol), j AS (SELECT * FROM g JOIN t USING (symbol)) SELECT symbol, 'low_sharpe' AS issue FROM j WHERE sharpe < 1 UNION ALL SELECT symbol, 'deep_drawdown' FROM j WHERE mdd < -0.15 UNION ALL SELECT symbol, 'low_profit_factor' FROM j WHERE pf < 1.2 UNION ALL SELECT symbol, 'long_underwater' FROM j WHERE tuw > 0.65")
def weak(spark, sf_dir):
    m = metrics.metric_pack(sample(spark, sf_dir).select("symbol", "date", F.col("close").alias("equity")), ["symbol"])
    return metrics.weak_points(m.join(metrics.trade_metrics(trades(spark, sf_dir), ["symbol"]), "symbol"), ["symbol"])


@query("a29_o10_parameter_grid", f"WITH {TRADES} SELECT year(date) AS year, " + ", ".join(f"{fx(f'avg(pnl) FILTER (month(date) = {m})')} AS m{m}" for m in range(1, 13)) + " FROM trades GROUP BY 1")
def parameter_grid(spark, sf_dir):
    t = trades(spark, sf_dir).groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(fixed(F.avg("pnl")).alias("mean"))
    g = metrics.grid(t, "year", "month", "mean", range(1, 13))
    return g.select("year", *[F.col(f"`{m}`").alias(f"m{m}") for m in range(1, 13)])


@query("a30_heatmap", f"WITH {TRADES}, t AS (SELECT CAST((isodow(date) - 1) AS VARCHAR) AS day, {'CAST(CAST(regexp_extract(symbol, ' + chr(39) + '([0-9]+)' + chr(39) + ', 1) AS INT) % 5 AS VARCHAR)'} AS sector, pnl FROM trades) SELECT coalesce(day, 'ALL') AS day, coalesce(sector, 'ALL') AS sector, count(pnl) AS n, {fx('sum(pnl)', 4)} AS total, {fx('avg((pnl > 0)::INT)')} AS hit_rate FROM t GROUP BY CUBE (day, sector)")
def heat(spark, sf_dir):
    t = trades(spark, sf_dir).select(F.weekday("date").cast("string").alias("day"), residual.sector_of(F.col("symbol")).alias("sector"), "pnl")
    return metrics.heatmap(t, "day", "sector", "pnl").withColumns({"total": fixed("total", 4), "hit_rate": fixed("hit_rate")})


@query("a31_risk_pack", f"WITH {RET}, {BENCH}, b AS (SELECT eq.*, market_return AS br, ret - market_return AS active FROM eq LEFT JOIN market_bench USING (date)), c AS (SELECT symbol, quantile_cont(ret, 0.05) AS v5, quantile_cont(ret, 0.95) AS v95 FROM b GROUP BY symbol), g AS (SELECT symbol, count(ret) AS n_returns, sum(ret) FILTER (ret > 0) / abs(sum(ret) FILTER (ret < 0)) AS omega, stddev_samp(active) * sqrt(252.0) AS te, avg(active) / stddev_samp(active) * sqrt(252.0) AS ir, covar_pop(ret, br) / (var_pop(br) FILTER (ret IS NOT NULL)) AS beta, sqrt(avg(dd * dd)) AS ulcer, avg(abs(dd)) AS pain FROM b GROUP BY symbol), t AS (SELECT symbol, v5, v95, avg(ret) FILTER (ret <= v5) AS cvar FROM b JOIN c USING (symbol) GROUP BY symbol, v5, v95) SELECT symbol, n_returns, {fx('v5')} AS value_at_risk, {fx('cvar')} AS cvar, {fx('abs(v95) / abs(v5)')} AS tail_ratio, {fx('omega')} AS omega, {fx('te', 5)} AS tracking_error, {fx('ir')} AS information_ratio, {fx('beta')} AS beta, {fx('ulcer')} AS ulcer_index, {fx('pain')} AS pain_index FROM g JOIN t USING (symbol)")
def risk(spark, sf_dir):
    p = sample(spark, sf_dir)
    _, market = residual.benchmarks(p)
    df = metrics.risk_pack(p.select("symbol", "date", F.col("close").alias("equity")), market.withColumnRenamed("market_return", "bench_ret"), ["symbol"])
    names = ["value_at_risk", "cvar", "tail_ratio", "omega", "tracking_error", "information_ratio", "beta", "ulcer_index", "pain_index"]
    return df.select("symbol", "n_returns", *[fixed(c, 5 if c == "tracking_error" else 6).alias(c) for c in names])


CLS = f"{FEATS}, s AS (SELECT symbol, close_location AS score, (forward_return_5d > 0)::INT AS label FROM feats WHERE close_location IS NOT NULL AND forward_return_5d IS NOT NULL)"


@query("a31_classification_pack", f"WITH {CLS}, k AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY score) + (count(*) OVER (PARTITION BY symbol, score) - 1) / 2.0 AS rk FROM s), g AS (SELECT symbol, avg(pow(score - label, 2)) AS brier, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (score >= 0.5) AS p, count(*) FILTER (label = 1) AS y, count(*) FILTER (label = 0) AS n, sum(rk) FILTER (label = 1) AS ranks FROM k GROUP BY symbol) SELECT symbol, {fx('brier')} AS brier, {fx('tp / nullif(p, 0)')} AS precision, {fx('tp / nullif(y, 0)')} AS recall, {fx('(ranks - y * (y + 1) / 2.0) / nullif(y * n, 0)')} AS auc, {fx('2 * (tp / nullif(p, 0)) * (tp / nullif(y, 0)) / nullif(tp / nullif(p, 0) + tp / nullif(y, 0), 0)')} AS f1 FROM g")
def classes(spark, sf_dir):
    s = scored_input(spark, sf_dir, ["close_location"]).filter("close_location IS NOT NULL AND forward_return_5d IS NOT NULL").select("symbol", F.col("close_location").alias("score"), (F.col("forward_return_5d") > 0).cast("int").alias("label"))
    df = metrics.classification_pack(s, ["symbol"])
    return df.select("symbol", *[fixed(c).alias(c) for c in ("brier", "precision", "recall", "auc", "f1")])


@query("a31_concentration_index", f"WITH {BARS} SELECT date, {fx('sum(volume * volume) / (sum(volume) * sum(volume))')} AS hhi FROM panel GROUP BY date")
def hhi(spark, sf_dir):
    return metrics.concentration_index(sample(spark, sf_dir), ["date"], "volume").withColumn("hhi", fixed("hhi"))


@query("a32_drift", f"WITH {FEATS}, x AS (SELECT rvol_20 AS x, year(date) = 1995 AS ref, year(date) AS period FROM feats WHERE rvol_20 IS NOT NULL), e AS (SELECT list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM x WHERE ref), b AS (SELECT period, ref, len(list_filter(e, lambda q: q < x)) AS bin FROM x, e), c AS (SELECT period, bin, count(*) AS c, count(*) FILTER (ref) AS rf FROM b GROUP BY period, bin), base AS (SELECT bin, sum(rf) AS base FROM c GROUP BY bin), w AS (SELECT p.period, t.bin FROM (SELECT DISTINCT period FROM b) p, e, LATERAL (SELECT unnest(range(0, CAST(len(e.e) + 1 AS BIGINT))) AS bin) t), f AS (SELECT w.period, w.bin, coalesce(c.c, 0) AS c, coalesce(base, 0) AS base FROM w LEFT JOIN c USING (period, bin) LEFT JOIN base USING (bin)), q AS (SELECT *, c / (sum(c) OVER (PARTITION BY period)) AS p, base / (sum(base) OVER (PARTITION BY period)) AS q FROM f), s AS (SELECT period, c, (greatest(p, 1e-4) - greatest(q, 1e-4)) * ln(greatest(p, 1e-4) / greatest(q, 1e-4)) AS psi, abs(sum(p) OVER o - sum(q) OVER o) AS ks FROM q WINDOW o AS (PARTITION BY period ORDER BY bin)) SELECT period, CAST(sum(c) AS BIGINT) AS n, {fx('sum(psi)')} AS psi, {fx('max(ks)')} AS ks FROM s GROUP BY period")
def drift(spark, sf_dir):
    df = metrics.drift(scored_input(spark, sf_dir, ["rvol_20"]), "rvol_20", F.year("date") == 1995, F.year("date"))
    return df.withColumns({"psi": fixed("psi"), "ks": fixed("ks")})


@query("a32_rolling_ic", f"WITH {FEATS}, k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY mom_5d) + (count(*) OVER (PARTITION BY date, mom_5d) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY date ORDER BY forward_return_5d) + (count(*) OVER (PARTITION BY date, forward_return_5d) - 1) / 2.0::DOUBLE AS ry FROM feats WHERE mom_5d IS NOT NULL AND forward_return_5d IS NOT NULL), c AS (SELECT date, count(*) AS n, CASE WHEN stddev_pop(rx) * stddev_pop(ry) <> 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic FROM k GROUP BY date) SELECT date, n, {fx('ic')} AS ic, {fx('avg(ic) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} AS rolling_ic FROM c")
def rolling(spark, sf_dir):
    return metrics.rolling_ic(scored_input(spark, sf_dir, ["mom_5d"]), "mom_5d", "forward_return_5d").withColumns({"ic": fixed("ic"), "rolling_ic": fixed("rolling_ic")})


SW = (5, 25, 66, 126)


@query("a33_o2_o4_screener", f"WITH {BARS}, m AS (SELECT symbol, date, close, {mean0('volume', 20)} * close AS dollars, {', '.join(f'close / ({mean0(chr(99) + chr(108) + chr(111) + chr(115) + chr(101), k)}) AS ext_{k}' for k in SW)}, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM panel {W}), l AS (SELECT * FROM m WHERE back = 1 AND close >= 5 AND dollars >= 0), u AS (" + " UNION ALL ".join(f"(SELECT symbol, {k} AS source, ext_{k} AS ext FROM l WHERE ext_{k} IS NOT NULL ORDER BY ext_{k} DESC, symbol LIMIT 5)" for k in SW) + f"), g AS (SELECT symbol, list_sort(list(DISTINCT source)) AS s, max(ext) AS b FROM u GROUP BY symbol) SELECT symbol, array_to_string(s, ',') AS sources, {fx('b')} AS best_extension, CASE WHEN len(s) = 4 THEN 'all_round' WHEN list_min(s) >= 66 THEN 'long_run' WHEN list_max(s) <= 25 THEN 'fresh' ELSE 'mixed' END AS type, CAST(rank() OVER (ORDER BY len(s) DESC, b DESC) AS INT) AS composite_rank FROM g")
def screen(spark, sf_dir):
    df = metrics.screener(sample(spark, sf_dir), SW)
    return df.select("symbol", F.array_join("sources", ",").alias("sources"), fixed("best_extension").alias("best_extension"), "type", "composite_rank")


@query("a34_execution_quality", f"WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate, sum(l_quantity) AS q, avg(l_extendedprice / l_quantity) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), f AS (SELECT l_orderkey, sum(l_quantity) AS filled, sum(l_quantity * (l_extendedprice / l_quantity)) / sum(l_quantity) AS ap, min(l_shipdate) AS ff FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey), j AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS sg FROM o LEFT JOIN f ON l_orderkey = o_orderkey) SELECT o_orderpriority, count(*) AS n_orders, {fx('avg(coalesce(filled >= q, false)::INT)')} AS fill_rate, {fx('avg(coalesce(filled > 0 AND filled < q, false)::INT)')} AS partial_rate, {fx('avg((o_orderstatus = chr(79))::INT)')} AS cancel_rate, {fx('avg((o_orderstatus = chr(80))::INT)')} AS reject_rate, {fx('avg(sg * (ap / p - 1) * 1e4)', 2)} AS mean_slippage_bps, {fx('avg(epoch(ff) - epoch(o_orderdate))', 2)} AS mean_latency_s FROM j GROUP BY o_orderpriority")
def execution(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    sizes = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.avg(px).alias("limit_price"))
    status = F.when(F.col("o_orderstatus") == "O", "cancelled").when(F.col("o_orderstatus") == "P", "rejected").otherwise("done")
    orders = o.join(sizes, "o_orderkey").select(F.col("o_orderkey").alias("client_order_id"), "o_orderpriority", "quantity", "limit_price", F.when(F.col("o_orderstatus") == "F", "buy").otherwise("sell").alias("side"), status.alias("status"), F.col("o_orderdate").alias("sent_ts"))
    fills = l.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("client_order_id"), F.col("l_quantity").alias("fill_quantity"), px.alias("fill_price"), F.col("l_shipdate").alias("fill_ts"))
    df = metrics.execution_quality(orders, fills, ["o_orderpriority"])
    names = ["fill_rate", "partial_rate", "cancel_rate", "reject_rate", "mean_slippage_bps", "mean_latency_s"]
    return df.select("o_orderpriority", "n_orders", *[fixed(c, 2 if c.startswith("mean") else 6).alias(c) for c in names])


LAGS = range(1, 6)


@query("a35_autocorrelation", f"WITH {BARS}, d AS (SELECT symbol, date, returns, returns - avg(returns) OVER (PARTITION BY symbol) AS d FROM panel), l AS (SELECT *, {', '.join(f'lag(d, {k}) OVER w AS l{k}' for k in LAGS)} FROM d {W}), g AS (SELECT symbol, count(*) AS n, avg(returns) AS m, sum(d * d) AS g0, {', '.join(f'sum(d * l{k}) AS g{k}' for k in LAGS)} FROM l GROUP BY symbol) SELECT symbol, n, {fx('m')} AS mean, {', '.join(f'{fx(f'g{k} / g0')} AS acf_{k}' for k in LAGS)}, {fx('CASE WHEN g0 + ' + ' + '.join(f'2 * (1 - {k} / 6.0::DOUBLE) * g{k}' for k in LAGS) + ' > 0 THEN m / (sqrt(g0 + ' + ' + '.join(f'2 * (1 - {k} / 6.0::DOUBLE) * g{k}' for k in LAGS) + ') / n) END', 5)} AS newey_west_t FROM g")
def acf(spark, sf_dir):
    df = metrics.autocorrelation(sample(spark, sf_dir), "returns", ["symbol"])
    return df.select("symbol", "n", *[fixed(c, 5 if c == "newey_west_t" else 6).alias(c) for c in df.columns[2:]])


# regimes and catalogue
@query("w38_market_regime", f"WITH {BARS}, m AS (SELECT *, {mean0('close', 50)} AS m50, {mean0('close', 200)} AS m200, {at(21, f'stddev_pop(returns) OVER {r(20)}')} AS v20 FROM panel {W}), s AS (SELECT CASE WHEN m50 IS NOT NULL AND m200 IS NOT NULL AND v20 IS NOT NULL THEN (close > m50)::INT + (close > m200)::INT + (v20 < 0.025)::INT END AS s FROM m) SELECT CASE WHEN s > 2 THEN 'bull' WHEN s < 1 THEN 'bear' WHEN s IS NOT NULL THEN 'sideways' END AS bucket, count(*) AS n FROM s GROUP BY 1")
def buckets(spark, sf_dir):
    return fq.features(spark, sf_dir, ["regime_score"]).groupBy(regime.market_bucket(F.col("regime_score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("w39_market_breadth", f"WITH {BARS}, m AS (SELECT date, close, {mean0('close', 20)} AS s FROM panel {W}) SELECT date, {fx('avg((close > s)::INT)')} AS breadth, count(s) AS n_symbols FROM m GROUP BY date")
def breadth(spark, sf_dir):
    return regime.market_breadth(fq.features(spark, sf_dir, ["sma_20"])).withColumn("breadth", fixed("breadth"))


@query("w40_trailing_percentile", f"WITH {BARS}, m AS (SELECT symbol, date, volume * close AS d, list(volume * close) OVER {r(60)} AS l FROM panel {W}) SELECT symbol, date, CASE WHEN len(l) >= 60 THEN len(list_filter(l, lambda q: q <= d)) / 60 END AS dollar_volume_percentile FROM m")
def percentiles(spark, sf_dir):
    df = sample(spark, sf_dir).withColumn("dollars", F.col("volume") * F.col("close"))
    return df.select("symbol", "date", regime.trailing_percentile("dollars", 60).alias("dollar_volume_percentile"))


VOL = fx("stddev_pop(returns) OVER " + r(20), 9)


@query("w40_expanding_percentile", f"""WITH {BARS}, m AS (SELECT symbol, date, i, volume * close AS d, {at(21, VOL)} AS v FROM panel {W})
  SELECT a.symbol, a.date, CASE WHEN count(b.d) >= 60 THEN count(*) FILTER (b.d <= a.d) / count(b.d) END AS dollar_volume_percentile, CASE WHEN a.v IS NOT NULL AND count(b.v) >= 60 THEN count(*) FILTER (b.v <= a.v) / count(b.v) END AS volatility_percentile
  FROM m a JOIN m b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY a.symbol, a.date, a.i, a.d, a.v""")
def expanding(spark, sf_dir):
    """Dollar volume and 20-bar volatility against all of the symbol's history so far."""
    df = sample(spark, sf_dir).withColumns({"dollars": F.col("volume") * F.col("close"), "vol": fixed(std("returns", 20, 21), 9)}).select("symbol", "date", "dollars", "vol")
    return regime.expanding_percentiles(df, {"dollar_volume_percentile": "dollars", "volatility_percentile": "vol"}).drop("dollars", "vol")


@query("w48_factor_residuals")
def factor_residuals(spark, sf_dir):
    """Residuals to principal components: an eigenproblem that SQL does not state."""
    return factors.factor_residuals(sample(spark, sf_dir))


def catalogue_features(spark, sf_dir, names):
    return spec.compute(sample(spark, sf_dir), [*every_spec(), *catalogue.specs()], names)


C1 = ["depth_from_high_20", "bars_since_high_20", "bars_since_low_20", "inside_days_10", "higher_lows_10", "range_contraction", "base_width_20", "volume_dry_up", "price_z_20", "undercut_reclaim", "back_inside_range", "climax_fade"]


@query(
    "w61_w64_swing_state",
    f"WITH {BARS}, a AS (SELECT *, high - low AS rng, (high <= lag(high) OVER w AND low >= lag(low) OVER w)::INT::DOUBLE AS ins, (low > lag(low) OVER w)::INT::DOUBLE AS hl, {ratio('volume', mean0('volume', 20))} AS cx, max(high) OVER {r(20)} AS hi, min(low) OVER {r(20)} AS lo, min(low) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS plo, max(high) OVER (w ROWS BETWEEN 11 PRECEDING AND 2 PRECEDING) AS phi, lag(close) OVER w AS pc FROM panel {W}), b AS (SELECT *, {mean0('rng', 5)} AS r5, {mean0('rng', 20)} AS r20, {mean0('close', 20)} AS m20, {at(20, f'stddev_pop(close) OVER {r(20)}')} AS d20, arg_max(i, (high, i)) OVER {r(20)} AS ih, arg_min(i, (low, -i)) OVER {r(20)} AS il FROM a {W}) SELECT symbol, date, {fx(ratio('close - hi', at(20, 'hi')))} AS depth_from_high_20, {at(20, '(i - ih)::DOUBLE')} AS bars_since_high_20, {at(20, '(i - il)::DOUBLE')} AS bars_since_low_20, {at(11, f'sum(ins) OVER {r(10)}')} AS inside_days_10, {at(11, f'sum(hl) OVER {r(10)}')} AS higher_lows_10, {fx(ratio('r5', 'r20'))} AS range_contraction, {fx(ratio(at(20, 'hi') + ' - lo', 'close').replace('(CASE WHEN i >= 20 THEN hi END - lo)', '(CASE WHEN i >= 20 THEN hi - lo END)'))} AS base_width_20, {fx(ratio(mean0('volume', 5), mean0('volume', 20)))} AS volume_dry_up, {fx(ratio('close - m20', 'd20'), 5)} AS price_z_20, {at(11, '(low < plo AND close > plo)::INT::DOUBLE')} AS undercut_reclaim, {at(12, '(pc > phi AND close <= phi)::INT::DOUBLE')} AS back_inside_range, CASE WHEN lag(cx) OVER w IS NOT NULL THEN (lag(cx) OVER w >= 2 AND volume < lag(volume) OVER w)::INT::DOUBLE END AS climax_fade FROM b {W}",
)
def swing(spark, sf_dir):
    df = catalogue_features(spark, sf_dir, C1)
    rounded = {"depth_from_high_20": 6, "range_contraction": 6, "base_width_20": 6, "volume_dry_up": 6, "price_z_20": 5}
    return df.select("symbol", "date", *[fixed(n, rounded[n]).alias(n) if n in rounded else F.col(n) for n in C1])


C2 = ["realised_vol_20", "parkinson_20", "vol_of_vol_20", "wma_10", "vwma_20", "roc_10", "stoch_k_14", "stoch_d_14", "williams_r_14", "cci_20", "aroon_up_25", "aroon_down_25", "hist_vol_20", "obv", "mfi_14", "adl", "cmf_20", "pivot", "pivot_r1", "pivot_s1"]


@query(
    "w67_w69_indicator_catalogue",
    f"WITH {BARS}, a AS (SELECT *, (high + low + close) / 3 AS tp, lag(close) OVER w AS pc, {at(14, f'min(low) OVER {r(14)}')} AS lo14, {at(14, f'max(high) OVER {r(14)}')} AS hi14, coalesce(CASE WHEN high - low > 0 THEN ((close - low) - (high - close)) / (high - low) END, 0) * volume AS mfv, {at(21, f'stddev_pop(returns) OVER {r(20)}')} AS v20, list(close) OVER {r(10)} AS l10 FROM panel {W}), b AS (SELECT *, sign(tp - lag(tp) OVER w) AS rise, tp * volume AS flow, {ratio('close - lo14', 'hi14 - lo14')} AS k14, list(tp) OVER {r(20)} AS tl, arg_max(i, (high, i)) OVER {r(26)} AS ih, arg_min(i, (low, -i)) OVER {r(26)} AS il FROM a {W}), c AS (SELECT *, list_avg(tl) AS tm, sum(CASE WHEN rise = 1 THEN flow ELSE 0 END) OVER {r(14)} AS up, sum(CASE WHEN rise = -1 THEN flow ELSE 0 END) OVER {r(14)} AS dn FROM b {W}) SELECT symbol, date, {fx(at(21, f'sqrt(sum(returns * returns) OVER {r(20)})'))} AS realised_vol_20, {fx(at(20, f'sqrt((sum(pow(ln(high / low), 2)) OVER {r(20)}) / (20 * 4 * ln(2.0)))'))} AS parkinson_20, {fx(at(40, f'stddev_pop(v20) OVER {r(20)}'))} AS vol_of_vol_20, {fx(at(10, 'list_sum(list_transform(l10, lambda q, k: q * k)) / 55'), 4)} AS wma_10, {fx(at(20, f'(sum(close * volume) OVER {r(20)}) / (sum(volume) OVER {r(20)})'), 4)} AS vwma_20, {fx('100 * (' + ratio('close - lag(close, 10) OVER w', 'lag(close, 10) OVER w') + ')', 4)} AS roc_10, {fx('100 * k14', 5)} AS stoch_k_14, {fx(at(16, f'100 * (avg(k14) OVER {r(3)})'), 5)} AS stoch_d_14, {fx('-100 * (' + ratio('hi14 - close', 'hi14 - lo14') + ')', 5)} AS williams_r_14, {fx(at(20, 'CASE WHEN list_avg(list_transform(tl, lambda q: abs(q - tm))) > 0 THEN (tp - tm) / (0.015::DOUBLE * list_avg(list_transform(tl, lambda q: abs(q - tm)))) END'), 4)} AS cci_20, {at(26, '100 * (25 - (i - ih)::DOUBLE) / 25')} AS aroon_up_25, {at(26, '100 * (25 - (i - il)::DOUBLE) / 25')} AS aroon_down_25, {fx(at(21, f'(stddev_samp(log_returns) OVER {r(20)}) * sqrt(252.0)'), 5)} AS hist_vol_20, sum(coalesce(volume * sign(close - pc), 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS obv, {fx(at(15, 'CASE WHEN up + dn > 0 THEN 100 * up / (up + dn) END'), 4)} AS mfi_14, {fx('sum(mfv) OVER (w ROWS UNBOUNDED PRECEDING)', 4)} AS adl, {fx(at(20, f'(sum(mfv) OVER {r(20)}) / (sum(volume) OVER {r(20)})'))} AS cmf_20, {fx('(lag(high) OVER w + lag(low) OVER w + pc) / 3', 5)} AS pivot, {fx('2 * ((lag(high) OVER w + lag(low) OVER w + pc) / 3) - lag(low) OVER w', 5)} AS pivot_r1, {fx('2 * ((lag(high) OVER w + lag(low) OVER w + pc) / 3) - lag(high) OVER w', 5)} AS pivot_s1 FROM c {W}",
)
def indicators(spark, sf_dir):
    df = catalogue_features(spark, sf_dir, C2)
    places = {"wma_10": 4, "vwma_20": 4, "roc_10": 4, "stoch_k_14": 5, "stoch_d_14": 5, "williams_r_14": 5, "cci_20": 4, "hist_vol_20": 5, "mfi_14": 4, "adl": 4, "pivot": 5, "pivot_r1": 5, "pivot_s1": 5}
    return df.select("symbol", "date", *[F.col(n) if n in ("aroon_up_25", "aroon_down_25", "obv") else fixed(n, places.get(n, 6)).alias(n) for n in C2])


C3 = ["tema_20", "trix_15", "tsi_25_13", "ppo_12_26", "kama_10", "supertrend_10_3", "psar", "atr_deviation", "keltner_upper", "keltner_lower"]


@query("w70_recursive_indicators")
def recursive(spark, sf_dir):
    """Recursions; the tests hold them against plain loops."""
    return catalogue_features(spark, sf_dir, C3).select("symbol", "date", *C3)


@query("w65_w72_context", f"WITH {BARS}, {BENCH}, wk AS (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week, arg_max(close, date) AS wc FROM panel GROUP BY ALL), wm AS (SELECT symbol, week + 7 AS known, wc, avg(wc) OVER (PARTITION BY symbol ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM wk) SELECT p.symbol, p.date, {fx('returns - market_return')} AS vs_market, {fx('returns - sector_return')} AS vs_sector, {fx('sector_return - market_return')} AS sector_vs_market, CAST(last_day(p.date) - p.date AS INT) AS days_to_month_end, wm.wc AS week_close, CAST(sign(wc - m) AS DOUBLE) AS weekly_trend FROM panel p JOIN sectors USING (symbol) LEFT JOIN sector_bench USING (sector, date) LEFT JOIN market_bench USING (date) ASOF LEFT JOIN wm ON p.symbol = wm.symbol AND p.date >= wm.known")
def context(spark, sf_dir):
    p = residual.with_own_benchmark(sample(spark, sf_dir))
    df = catalogue.relative_context(p).join(catalogue.higher_timeframe(p).select("symbol", "date", "week_close", "weekly_trend"), ["symbol", "date"])
    return df.select("symbol", "date", *[fixed(c).alias(c) for c in ("vs_market", "vs_sector", "sector_vs_market")], "days_to_month_end", "week_close", "weekly_trend")


#: Reports of each brand's quarters: a first one of a part of the lines, a restatement, and for every other quarter a second one after a year; estimates before and after the first report.
FUNDAMENTALS_SQL = """lines AS (SELECT p_brand AS symbol, last_day(date_trunc('quarter', CAST(l_shipdate AS DATE)) + INTERVAL 2 MONTH) AS period, l_linenumber AS k, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey
), sums AS (SELECT symbol, period, sum(q) FILTER (k <= 4) AS a, sum(q) AS b, sum(q) FILTER (k <> 2) AS c, sum(q) FILTER (k <= 2) * 2 AS e1, sum(q) FILTER (k <= 3) * 1.25 AS e2, sum(q) FILTER (k = 1) * 4 AS e3 FROM lines GROUP BY symbol, period
), facts AS (SELECT symbol, period, period + 30 AS known, a AS value FROM sums WHERE a IS NOT NULL UNION ALL SELECT symbol, period, period + 70, b FROM sums UNION ALL SELECT symbol, period, period + 410, c FROM sums WHERE month(period) % 2 = 1 OR quarter(period) = 2 AND c IS NOT NULL
), est AS (SELECT symbol, period, period - 15 AS known, e1 AS estimate FROM sums WHERE e1 IS NOT NULL UNION ALL SELECT symbol, period, period + 20, e2 FROM sums WHERE e2 IS NOT NULL UNION ALL SELECT symbol, period, period + 45, e3 FROM sums WHERE e3 IS NOT NULL)"""


def fundamentals_of(spark, sf_dir):
    """facts and estimates of the brands, as FUNDAMENTALS_SQL has them."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = l.join(p, l["l_partkey"] == p["p_partkey"]).select(F.col("p_brand").alias("symbol"), F.last_day(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 2)).alias("period"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("q"))
    some = lambda c: F.sum(F.when(c, F.col("q")))
    k = F.col("k")
    s = rows.groupBy("symbol", "period").agg(some(k <= 4).alias("a"), F.sum("q").alias("b"), some(k != 2).alias("c"), (some(k <= 2) * 2).alias("e1"), (some(k <= 3) * 1.25).alias("e2"), (some(k == 1) * 4).alias("e3"))
    at = lambda days, c, name: s.select("symbol", "period", F.date_add("period", days).alias("known"), F.col(c).cast("double").alias(name))
    changed = (F.month("period") % 2 == 1) | (F.quarter("period") == 2)
    return at(30, "a", "value").union(at(70, "b", "value")).union(at(410, "c", "value").filter(changed)), at(-15, "e1", "estimate").union(at(20, "e2", "estimate")).union(at(45, "e3", "estimate"))


@query("w72_fundamentals", f"""WITH {BARS}, {FUNDAMENTALS_SQL}, last_ AS (SELECT p.symbol, p.date, max(f.period) AS period FROM panel p JOIN facts f ON f.symbol = p.symbol AND f.known <= p.date GROUP BY p.symbol, p.date
  ), own AS (SELECT l.symbol, l.date, l.period, arg_max(f.value, f.known) AS value, arg_min(f.value, f.known) AS first_value, min(f.known) AS reported FROM last_ l JOIN facts f ON f.symbol = l.symbol AND f.period = l.period AND f.known <= l.date GROUP BY ALL
  ), base AS (SELECT l.symbol, l.date, arg_max(f.value, f.known) AS base FROM last_ l JOIN facts f ON f.symbol = l.symbol AND f.period = last_day(l.period - INTERVAL 1 YEAR) AND f.known <= l.date GROUP BY ALL
  ), best AS (SELECT o.symbol, o.date, arg_max(e.estimate, e.known) AS estimate FROM own o JOIN est e ON e.symbol = o.symbol AND e.period = o.period AND e.known < o.reported GROUP BY ALL)
  SELECT p.symbol, p.date, o.period, CAST(o.value AS DOUBLE) AS value, {fx('CASE WHEN estimate <> 0 THEN (o.first_value - estimate) / abs(estimate) END')} AS surprise, {fx('CASE WHEN base > 0 THEN o.value / base - 1 END')} AS growth, CAST(p.date - o.reported AS INT) AS report_age
  FROM panel p LEFT JOIN own o USING (symbol, date) LEFT JOIN base USING (symbol, date) LEFT JOIN best USING (symbol, date)""")
def fundamental(spark, sf_dir):
    """Surprise, growth and age of each brand's latest quarter as known on each bar's date, with restatements of quarters and of those a year before."""
    out = fundamentals.fundamental_context(sample(spark, sf_dir).select("symbol", "date"), *fundamentals_of(spark, sf_dir))
    return out.select("symbol", "date", "period", "value", fixed("surprise").alias("surprise"), fixed("growth").alias("growth"), "report_age")


@query("w66_pullback_features", f"WITH {BARS} SELECT symbol, date, {fx(at(5, f'avg(close) OVER {r(5)}'), 4)} AS fast_ma, {fx(at(20, f'avg(close) OVER {r(20)}'), 4)} AS slow_ma, {at(10, f'close / (max(close) OVER {r(10)}) - 1')} AS pullback FROM panel {W}")
def pullbacks(spark, sf_dir):
    return events.pullback_features(sample(spark, sf_dir)).select("symbol", "date", fixed("fast_ma", 4).alias("fast_ma"), fixed("slow_ma", 4).alias("slow_ma"), "pullback")


@query("w68_cross_sectional_momentum", f"WITH {BARS}, {BENCH}, m AS (SELECT symbol, date, sector, CASE WHEN lag(close, 252) OVER w > 0 THEN lag(close, 21) OVER w / lag(close, 252) OVER w - 1 END AS momentum FROM panel JOIN sectors USING (symbol) {W}) SELECT symbol, date, sector, momentum, percent_rank() OVER (PARTITION BY date ORDER BY momentum) AS momentum_rank, {fx('(momentum - avg(momentum) OVER d) / nullif(stddev_pop(momentum) OVER d, 0)')} AS momentum_z, percent_rank() OVER (PARTITION BY date, sector ORDER BY momentum) AS sector_rank FROM m WHERE momentum IS NOT NULL WINDOW d AS (PARTITION BY date)")
def momentum(spark, sf_dir):
    df = catalogue.cross_sectional_momentum(sample(spark, sf_dir), residual.sector_of(F.col("symbol")))
    return df.withColumn("momentum_z", fixed("momentum_z"))


@query("w71_breadth_lines", f"WITH RECURSIVE {BARS}, d AS (SELECT date, count(*) FILTER (returns > 0) AS advances, count(*) FILTER (returns < 0) AS declines, row_number() OVER (ORDER BY date) AS k FROM panel WHERE i > 1 GROUP BY date), seeds AS (SELECT avg(advances - declines) FILTER (k <= 19) AS s19, avg(advances - declines) FILTER (k <= 39) AS s39 FROM d), walk(k, e19, e39) AS (SELECT CAST(19 AS BIGINT), s19, CAST(NULL AS DOUBLE) FROM seeds UNION ALL SELECT d.k, 2.0::DOUBLE / 20 * (advances - declines) + (1 - 2.0::DOUBLE / 20) * walk.e19, CASE WHEN d.k = 39 THEN s39 WHEN d.k > 39 THEN 2.0::DOUBLE / 40 * (advances - declines) + (1 - 2.0::DOUBLE / 40) * walk.e39 END FROM walk JOIN d ON d.k = walk.k + 1, seeds) SELECT date, advances, declines, advances - declines AS net, CAST(sum(advances - declines) OVER (ORDER BY date) AS BIGINT) AS ad_line, {fx('advances / nullif(declines, 0)')} AS ad_ratio, {fx('e19 - e39', 4)} AS mcclellan FROM d LEFT JOIN walk USING (k)")
def lines(spark, sf_dir):
    return catalogue.breadth_lines(sample(spark, sf_dir)).withColumns({"ad_ratio": fixed("ad_ratio"), "mcclellan": fixed("mcclellan", 4)})


# ledgers
LEDGER_SQL = f"""{BARS}, {OBSERVED}, led AS (
  SELECT o.observation_id, o.symbol, o.signal_date, CASE WHEN o.status = 'O' THEN 'PENDING' ELSE 'RESOLVED' END AS outcome_status, p.close AS signal_close,
         p.i AS own, CASE WHEN p5.close > 0 THEN p.close / p5.close - 1 END AS ret_5d
  FROM obs o ASOF LEFT JOIN panel p ON o.symbol = p.symbol AND o.signal_date >= p.date LEFT JOIN panel p5 ON p5.symbol = o.symbol AND p5.i = p.i - 5
), kept AS (SELECT * FROM led WHERE signal_close IS NOT NULL AND ret_5d IS NOT NULL)"""
VIEW_SQL = f"CASE WHEN outcome_status = 'PENDING' THEN CASE WHEN ret_5d >= 0.15 THEN '{ledger.PULLBACK}' ELSE '{ledger.PROOF}' END WHEN ret_5d <= -0.08 THEN '{ledger.WEAK}' ELSE '{ledger.BULLISH}' END"
RISK_SQL = f"CASE WHEN ret_5d >= 0.15 THEN '{ledger.STRETCHED}' WHEN ret_5d <= -0.05 THEN '{ledger.WEAK}' ELSE '{ledger.HIGH_RISK}' END"


def observed_ledger(spark, sf_dir):
    """Orders as an observation ledger with the close and 5-bar return known at the signal."""
    from qpanel.operators import joins

    p = sample(spark, sf_dir)
    before = F.lag("close", 5).over(by_symbol())
    known = p.select("symbol", "date", F.col("close").alias("signal_close"), F.when(before > 0, F.col("close") / before - 1).alias("ret_5d"))
    o = observations(spark, sf_dir).select("observation_id", "symbol", "signal_date", F.when(F.col("status") == "O", "PENDING").otherwise("RESOLVED").alias("outcome_status"))
    return joins.asof(o, known, ["symbol"], "signal_date", "date", ["signal_close", "ret_5d"]).drop("asof_date").filter("signal_close IS NOT NULL AND ret_5d IS NOT NULL"), p


@query("b1_b2_cards", f"WITH {LEDGER_SQL} SELECT observation_id, upper(symbol) AS symbol, {VIEW_SQL} AS main_view, {RISK_SQL} AS main_risk, CASE WHEN ret_5d >= 0.15 THEN '{ledger.CHANGES[0]}' WHEN ret_5d <= -0.05 THEN '{ledger.CHANGES[1]}' WHEN outcome_status = 'PENDING' THEN '{ledger.CHANGES[2]}' ELSE '{ledger.CHANGES[3]}' END AS what_changed, CASE WHEN outcome_status = 'PENDING' AND ret_5d >= 0.15 THEN '{ledger.SHORT_RANGE}' ELSE '{ledger.SWING_RANGE}' END AS time_range, '84' AS score, CASE WHEN outcome_status = 'PENDING' THEN 'still maturing' ELSE 'matured' END AS maturity_status FROM kept")
def card_rows(spark, sf_dir):
    o, _ = observed_ledger(spark, sf_dir)
    none = spark.createDataFrame([], "symbol string, future_bars long, bars_remaining long")
    return ledger.cards(o, none, "B+").select("observation_id", "symbol", "main_view", "main_risk", "what_changed", "time_range", "score", "maturity_status")


@query(
    "b3_b6_j8_scoreboard",
    f"WITH {LEDGER_SQL}, tail AS (SELECT symbol, i, min(low) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM panel), last AS (SELECT symbol, max(i) AS n, arg_max(close, date) AS current_price FROM panel GROUP BY symbol), b AS (SELECT k.*, l.current_price, l.n - own AS bars_elapsed, round(signal_close * 0.96::DOUBLE, 2) AS brk, later, c5.close AS c5, c10.close AS c10, c20.close AS c20 FROM kept k JOIN last l USING (symbol) JOIN tail t ON t.symbol = k.symbol AND t.i = own LEFT JOIN panel c5 ON c5.symbol = k.symbol AND c5.i = own + 5 LEFT JOIN panel c10 ON c10.symbol = k.symbol AND c10.i = own + 10 LEFT JOIN panel c20 ON c20.symbol = k.symbol AND c20.i = own + 20) SELECT observation_id, symbol, signal_date, bars_elapsed, coalesce(later <= brk, false) AS setup_broke, CASE WHEN coalesce(later <= brk, false) THEN 'Setup Broke' WHEN bars_elapsed >= 20 THEN '20-Day Mature' WHEN bars_elapsed >= 10 THEN '10-Day Mature' WHEN bars_elapsed >= 5 THEN '5-Day Mature' ELSE 'Still Maturing' END AS maturity_status, current_price, c5 IS NOT NULL AS has_5, c10 IS NOT NULL AS has_10, c20 IS NOT NULL AS has_20 FROM b",
)
def board(spark, sf_dir):
    o, p = observed_ledger(spark, sf_dir)
    df = ledger.scoreboard(o, p)
    return df.select("observation_id", "symbol", "signal_date", "bars_elapsed", "setup_broke", "maturity_status", "current_price", *[F.col(f"result_{k}_day").isNotNull().alias(f"has_{k}") for k in (5, 10, 20)])


@query("b7_b9_sections_counts", f"WITH {LEDGER_SQL}, c AS (SELECT {VIEW_SQL} AS v, {RISK_SQL} AS k FROM kept) SELECT section, count(*) AS n FROM (SELECT CASE WHEN v = '{ledger.BULLISH}' THEN 'bullish' WHEN v LIKE 'Waiting%' THEN 'waiting' ELSE 'no_edge' END AS section FROM c UNION ALL SELECT 'too_stretched' FROM c WHERE k = '{ledger.STRETCHED}' UNION ALL SELECT 'pending' FROM kept WHERE outcome_status = 'PENDING' UNION ALL SELECT 'outcomes' FROM kept WHERE outcome_status <> 'PENDING') GROUP BY section")
def section_counts(spark, sf_dir):
    o, _ = observed_ledger(spark, sf_dir)
    s = ledger.sections(ledger.card_view(o)).groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    n = ledger.counts(o).select(F.explode(F.array(F.struct(F.lit("pending").alias("section"), F.col("pending").alias("n")), F.struct(F.lit("outcomes").alias("section"), F.col("outcomes").alias("n")))).alias("x")).select("x.*")
    return s.unionByName(n)


@query("b10_b11_freshness", f"WITH {BARS}, {OBSERVED}, s AS (SELECT symbol, max(signal_date) AS signal_date FROM obs GROUP BY symbol), a AS (SELECT s.symbol, s.signal_date, max(p.date) AS last_date, count(p.date) AS rows, least(10, count(*) FILTER (p.date > s.signal_date)) AS bars_after FROM s LEFT JOIN panel p USING (symbol) GROUP BY s.symbol, s.signal_date) SELECT symbol, signal_date, last_date, rows, bars_after, CASE WHEN last_date IS NULL THEN 'MISSING' WHEN DATE '2001-11-05' - last_date > 4 THEN 'STALE' ELSE 'FRESH' END AS status, greatest(0, 10 - bars_after) AS bars_remaining FROM a")
def fresh(spark, sf_dir):
    s = observations(spark, sf_dir).groupBy("symbol").agg(F.max("signal_date").alias("signal_date"))
    df = ledger.freshness(s, sample(spark, sf_dir), "2001-11-05")
    return df.select("symbol", "signal_date", "last_date", "rows", "bars_after", "status", "bars_remaining")


# sources and store
@query("s4_bars", f"WITH {BARS} SELECT * FROM bars")
def bars(spark, sf_dir):
    return bars_from_lines(spark, sf_dir)


@query("s2_s3_panel", f"WITH {BARS} SELECT symbol, date, open, high, low, close, volume, CAST(i AS INT) AS i, returns, {fx('log_returns', 9)} AS log_returns FROM panel")
def the_panel(spark, sf_dir):
    return sample(spark, sf_dir).withColumn("log_returns", fixed("log_returns", 9))


@query("s1_s5_csv_bars", f"WITH {BARS} SELECT count(*) AS n_bars, count(*) FILTER (NOT (low <= open AND open <= high AND low <= close AND close <= high)) AS bad_ohlc, 0::BIGINT AS negative_volume, 0::BIGINT AS missing FROM bars")
def csv_bars(spark, sf_dir):
    """Bars written as CSV, read again by the flexible reader and validated."""
    root = shared_root(spark)
    bars_from_lines(spark, sf_dir).withColumnRenamed("date", "timestamp").write.option("header", True).csv(root)
    return sources.validate(sources.read_csv_bars(spark, root))


@query("s6_normalise", f"WITH {BARS}, u AS (SELECT symbol, date, close, 1 AS k FROM bars UNION ALL SELECT symbol, date, close + 1, 2 FROM bars WHERE volume > 40) SELECT symbol, date, arg_max(close, k) AS close FROM u GROUP BY symbol, date")
def normal(spark, sf_dir):
    b = bars_from_lines(spark, sf_dir).select("symbol", "date", "close", "volume")
    late = b.filter("volume > 40").withColumns({"close": F.col("close") + 1, "symbol": F.concat(F.lit("  "), F.lower("symbol"))})
    both = b.withColumn("ingest_order", F.lit(1)).unionByName(late.withColumn("ingest_order", F.lit(2)))
    return sources.normalise(both).select(F.concat(F.lit("Brand#"), F.substring("symbol", 7, 9)).alias("symbol"), "date", "close")


@query("s7_quality_profile", f"WITH {BARS}, a AS (SELECT *, CASE WHEN lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END AS ret, close = lag(close) OVER w AS same FROM bars {W}), z AS (SELECT *, abs(ret - avg(ret) OVER p) / nullif(stddev_pop(ret) OVER p, 0) AS z FROM a WINDOW p AS (PARTITION BY symbol)), g AS (SELECT symbol, count(*) AS n_bars, (5 * (((max(date) + 1) - DATE '1970-01-05') // 7) + least(((max(date) + 1) - DATE '1970-01-05') % 7, 5)) - (5 * ((min(date) - DATE '1970-01-05') // 7) + least((min(date) - DATE '1970-01-05') % 7, 5)) AS sessions, count(DISTINCT CASE WHEN isodow(date) <= 5 THEN date END) AS met, count(*) FILTER (isodow(date) > 5) AS out_of_session, count(*) FILTER (z > 4) AS outliers, count(*) FILTER (same) AS flatline FROM z GROUP BY symbol) SELECT symbol, n_bars, sessions - met AS missing_days, out_of_session, outliers, flatline, {fx('greatest(0, 100 - coalesce(10 * ((sessions - met) / nullif(sessions, 0)), 0) - 10 * outliers / n_bars)')} AS score FROM g")
def profile(spark, sf_dir):
    return sources.quality_profile(bars_from_lines(spark, sf_dir)).select("symbol", "n_bars", "missing_days", "out_of_session", "outliers", "flatline", fixed("score").alias("score"))


@query("s8_s13_feature_store", f"WITH {FEATS}, u AS (SELECT f.feature, symbol, date, f.v FROM feats, LATERAL (VALUES ('mom_5d', mom_5d), ('rvol_20', rvol_20)) f(feature, v)), g AS (SELECT feature, symbol, count(*) AS n_values, count(*) FILTER (v IS NULL) AS n_nan, {fx('avg(v)')} AS mean FROM u GROUP BY feature, symbol), l AS (SELECT feature, symbol, arg_max(v, date) AS last_value FROM u WHERE v IS NOT NULL AND date <= DATE '1997-06-30' GROUP BY feature, symbol) SELECT feature, symbol, n_values, n_nan, mean, last_value FROM g LEFT JOIN l USING (feature, symbol)")
def stored(spark, sf_dir):
    """A version written, read again, its catalog and its values as of a date."""
    s = store.FeatureStore(spark, shared_root(spark))
    s.write(scored_input(spark, sf_dir, ["mom_5d", "rvol_20"]).select("symbol", "date", "mom_5d", "rvol_20"), {"mom_5d": "statistical", "rvol_20": "technical"}, "v1")
    asof = s.read().filter((F.col("date") <= F.to_date(F.lit("1997-06-30"))) & F.col("value").isNotNull()).groupBy("feature", "symbol").agg(F.max_by("value", "date").alias("last_value"))
    return s.catalog(version="v1").select("feature", "symbol", "n_values", "n_nan", fixed("mean").alias("mean")).join(asof, ["feature", "symbol"], "left")


@query("s14_s15_feature_matrix", f"WITH {FEATS} SELECT symbol, date, mom_5d, rvol_20, forward_return_5d, forward_return_20d, 2 AS vector_size, mom_5d AS vector_first, rvol_20 AS vector_last FROM feats")
def matrix(spark, sf_dir):
    """Features of all symbols, also as one array, and their labels, each from the store."""
    s = store.FeatureStore(spark, shared_root(spark))
    kinds = {"mom_5d": "statistical", "rvol_20": "technical", "forward_return_5d": "label", "forward_return_20d": "label"}
    s.write(scored_input(spark, sf_dir, ["mom_5d", "rvol_20"]).select("symbol", "date", *kinds), kinds, "v1")
    labels_ = s.matrix(["forward_return_5d", "forward_return_20d"]).drop("vector")
    df = s.matrix(["mom_5d", "rvol_20"]).join(labels_, ["symbol", "date"])
    return df.select("*", F.size("vector").alias("vector_size"), F.col("vector")[0].alias("vector_first"), F.col("vector")[1].alias("vector_last")).drop("vector")


@query("s13_point_in_time", f"WITH {FEATS}, u AS (SELECT f.feature, date, f.v FROM feats, LATERAL (VALUES ('mom_5d', mom_5d), ('rvol_20', rvol_20)) f(feature, v) WHERE symbol = (SELECT min(symbol) FROM feats) AND f.v IS NOT NULL AND date <= DATE '1997-06-30') SELECT feature, arg_max(v, date) AS value, max(date) AS date FROM u GROUP BY feature")
def point_in_time(spark, sf_dir):
    """One symbol's features as they were known at a date: the lookup is the feature."""
    s = store.FeatureStore(spark, shared_root(spark))
    df = scored_input(spark, sf_dir, ["mom_5d", "rvol_20"]).select("symbol", "date", "mom_5d", "rvol_20")
    s.write(df, {"mom_5d": "statistical", "rvol_20": "technical"}, "v1")
    symbol = s.read().agg(F.min("symbol")).first()[0]
    return s.at(symbol, "1997-06-30")


# scalars and sets
@query("p12_p15_p16_scalars", "WITH o AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS d, o_orderpriority FROM orders) SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN '90' WHEN o_orderpriority LIKE '2%' THEN '84' WHEN o_orderpriority LIKE '3%' THEN '80' WHEN o_orderpriority LIKE '4%' THEN '70' ELSE 'none' END AS points, CAST(isodow(d) - 1 AS INT) AS day_of_week, last_day(d) - d <= 3 AS month_end_window, last_day(d) - d <= 3 AND month(d) % 3 = 0 AS quarter_end_window, CAST(last_day(d) - d AS INT) AS days_to_month_end, CAST(d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) AS next_trading_day FROM o")
def scalars(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    grade = F.create_map(*[F.lit(x) for p in (("1", "A"), ("2", "B+"), ("3", "B"), ("4", "C")) for x in p])[F.substring("o_orderpriority", 1, 1)]
    days = text.calendar(spark, "1990-01-01", "2005-01-01").select("date", "next_trading_day")
    f = text.calendar_features()
    df = o.select("o_orderkey", "date", F.coalesce(text.grade_score(grade), F.lit("none")).alias("points"), *[f[n].alias(n) for n in ("day_of_week", "month_end_window", "quarter_end_window", "days_to_month_end")])
    # a day off is followed by Monday
    return df.join(days, "date", "left").withColumn("next_trading_day", F.coalesce("next_trading_day", F.date_add("date", F.lit(7) - F.weekday("date")))).drop("date")


@query("p17_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")


@query("p18_candle_geometry", f"WITH {BARS} SELECT symbol, date, {ratio('abs(close - open)', 'high - low')} AS body_pct, {ratio('high - greatest(open, close)', 'high - low')} AS upper_wick_pct, {ratio('least(open, close) - low', 'high - low')} AS lower_wick_pct, {ratio('(close - low) - (high - close)', 'high - low')} AS clv, {ratio('high - low', 'close')} AS range_pct, CASE WHEN lag(close) OVER w > 0 THEN open / lag(close) OVER w - 1 END AS gap_pct FROM panel {W}")
def candles(spark, sf_dir):
    df = sample(spark, sf_dir)
    shape = text.candle(F.lag("close").over(by_symbol()))
    return df.select("symbol", "date", *[x.alias(n) for n, x in shape.items()])


@query("o5_o7_set_operations", f"WITH {OBSERVED}, a AS (SELECT symbol, signal_date FROM obs WHERE status = 'F'), b AS (SELECT symbol, signal_date FROM obs WHERE amount > 100000) SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS in_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS in_any, (SELECT count(DISTINCT symbol) FROM obs) AS symbols")
def set_operations(spark, sf_dir):
    o = observations(spark, sf_dir)
    a, b = o.filter("status = 'F'").select("symbol", "signal_date"), o.filter("amount > 100000").select("symbol", "signal_date")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(a.intersect(b), "in_both")
    for part in (n(a.exceptAll(b), "only_a"), n(a.unionByName(b).distinct(), "in_any"), o.agg(F.countDistinct("symbol").alias("symbols"))):
        out = out.join(F.broadcast(part))
    return out



@query("s10_s12_store_summary", f"WITH {FEATS}, u AS (SELECT f.category, f.feature, f.v FROM feats, LATERAL (VALUES ('statistical', 'mom_5d', mom_5d), ('statistical', 'mom_20d', mom_20d), ('technical', 'rvol_20', rvol_20)) f(category, feature, v)), v(version) AS (VALUES ('v1'), ('v2')) SELECT version, category, count(DISTINCT feature) AS n_features, count(*) AS n_values FROM u, v GROUP BY version, category")
def store_summary(spark, sf_dir):
    """Two versions written; counts of each category by version."""
    s = store.FeatureStore(spark, shared_root(spark))
    wide = scored_input(spark, sf_dir, ["mom_5d", "mom_20d", "rvol_20"]).select("symbol", "date", "mom_5d", "mom_20d", "rvol_20")
    for version in ("v1", "v2"):
        s.write(wide, {"mom_5d": "statistical", "mom_20d": "statistical", "rvol_20": "technical"}, version)
    parts = [s.summary(v).withColumn("version", F.lit(v)) for v in ("v1", "v2")]
    return parts[0].unionByName(parts[1]).select("version", "category", "n_features", "n_values")


@query("s11_mergeable_summaries", f"""WITH {FEATS}, u AS (SELECT f.feature, f.v FROM feats, LATERAL (VALUES ('mom_5d', mom_5d), ('mom_20d', mom_20d), ('rvol_20', rvol_20)) f(feature, v)), p(p) AS (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE))
  SELECT feature, p AS probability, count(*) AS n_values, count(*) - count(v) AS n_nan, true AS rank_within, true AS distinct_within FROM u, p GROUP BY feature, p""")
def mergeable(spark, sf_dir):
    """Features written as two versions, the odd and the even bars; percentiles and distinct values of both together from the catalog, each held against all values: within three times the sketches' deviation."""
    s, names = store.FeatureStore(spark, shared_root(spark)), ["mom_5d", "mom_20d", "rvol_20"]
    wide = scored_input(spark, sf_dir, names).select("symbol", "date", "i", *names)
    for k, version in enumerate(("odd", "even")):
        s.write(wide.filter(F.col("i") % 2 == 1 - k).drop("i"), {n: "statistical" for n in names}, version)
    levels = [0.05, 0.5, 0.95]
    found = s.distributions(levels, ["odd", "even"])
    each = found.select("feature", "n_values", "n_nan", "n_distinct", F.posexplode("percentiles").alias("k", "cut")).withColumn("probability", F.element_at(F.array(*map(F.lit, levels)), F.col("k") + 1))
    v = wide.select(*names).unpivot([], names, "feature", "value").filter("value IS NOT NULL")
    ranks = v.join(F.broadcast(each.select("feature", "probability", "cut")), "feature").groupBy("feature", "probability").agg(F.avg((F.col("value") <= F.col("cut")).cast("double")).alias("rank"), F.countDistinct("value").alias("exact"))
    df = each.join(ranks, ["feature", "probability"])
    return df.select("feature", "probability", "n_values", "n_nan", (F.abs(F.col("rank") - F.col("probability")) <= 0.02).alias("rank_within"), (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.05 * F.col("exact")).alias("distinct_within"))


@query("s16_s17_ledger_round_trip", f"WITH {OBSERVED} SELECT observation_id, symbol, CAST(signal_date AS VARCHAR) AS signal_date, amount, 'run1' AS run_id FROM obs")
def ledger_round_trip(spark, sf_dir):
    """A ledger written as CSV, read with a fixed schema, and sent to a report as JSON."""
    root = shared_root(spark)
    observations(spark, sf_dir).select("observation_id", "symbol", "signal_date", "amount").write.option("header", True).csv(f"{root}/ledger")
    read = store.read_ledger(spark, f"{root}/ledger", "observation_id long, symbol string, signal_date string, amount double").drop("_corrupt_record")
    store.write_report(read, f"{root}/report", "run1")
    return spark.read.schema("observation_id long, symbol string, signal_date string, amount double, run_id string").json(f"{root}/report")


@query("s18_feature_cache", f"WITH {FEATS} SELECT symbol, count(*) AS n, {fx('avg(mom_5d)')} AS mean_momentum, {fx('avg(forward_return_5d)')} AS mean_return FROM feats GROUP BY symbol")
def feature_cache(spark, sf_dir):
    """A slim cache bucketed by symbol, aggregated without another shuffle by symbol."""
    s = store.FeatureStore(spark, shared_root(spark))
    slim = s.cache(scored_input(spark, sf_dir, ["mom_5d"]).select("symbol", "date", "mom_5d", "forward_return_5d"), f"cache_{uuid.uuid4().hex}")
    return slim.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), fixed(F.avg("mom_5d")).alias("mean_momentum"), fixed(F.avg("forward_return_5d")).alias("mean_return"))


@query("v4_cluster_representative", f"WITH {FEATS}, u AS (SELECT f.cluster, f.feature, f.v FROM feats, LATERAL (VALUES ('trend', 'mom_5d', mom_5d), ('trend', 'mom_20d', mom_20d), ('flow', 'rvol_20', rvol_20), ('flow', 'close_location', close_location)) f(cluster, feature, v)), g AS (SELECT cluster, feature, count(*) FILTER (v IS NULL) / count(*) AS missing FROM u GROUP BY cluster, feature) SELECT cluster, arg_max(feature, (-0.5 * missing, feature)) AS representative FROM g GROUP BY cluster")
def representatives(spark, sf_dir):
    """The most complete member of each cluster, where IC and stability are the same."""
    from qpanel.operators import scoring, validation

    names = ["mom_5d", "mom_20d", "rvol_20", "close_location"]
    st = scoring.statistics(scored_input(spark, sf_dir), names).groupBy("feature").agg((F.sum("n_nan") / F.sum("n_values")).alias("missing_rate"))
    scores = st.withColumns({"ic": F.lit(0.0), "stability": F.lit(0.0)})
    clusters = spark.createDataFrame([("trend", "mom_5d"), ("trend", "mom_20d"), ("flow", "rvol_20"), ("flow", "close_location")], "cluster string, feature string")
    return validation.representative(scores, clusters)


@query("a2_category_counts", f"WITH {FEATS}, u AS (SELECT f.category, f.v FROM feats, LATERAL (VALUES ('statistical', mom_5d), ('statistical', mom_20d), ('technical', rvol_20), ('microstructure', close_location)) f(category, v)) SELECT category, count(v) AS n_present, count(*) AS n_values FROM u GROUP BY category")
def category_counts(spark, sf_dir):
    kinds = {x.name: x.category for x in every_spec()}
    names = ["mom_5d", "mom_20d", "rvol_20", "close_location"]
    rows = F.array(*[F.struct(F.lit(kinds[n]).alias("category"), F.col(n).alias("v")) for n in names])
    return scored_input(spark, sf_dir, names).select(F.explode(rows).alias("r")).select("r.*").groupBy("category").agg(F.count("v").alias("n_present"), F.count(F.lit(1)).alias("n_values"))
