"""Performance, risk, drift and execution metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qpanel.functions.windows import safe_corr
from qpanel.sources.tables import settled

from .quantiles import quantiles

YEAR = 252


def returns_of(equity: DataFrame, by: Sequence[str], order: str = "date") -> DataFrame:
    """Equity with its return, running peak and drawdown along each curve."""
    w = Window.partitionBy(*by).orderBy(order)
    df = equity.withColumns({"_before": F.lag("equity").over(w), "_peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return df.withColumns({"ret": F.when(F.col("_before") > 0, F.col("equity") / F.col("_before") - 1), "drawdown": F.col("equity") / F.col("_peak") - 1}).drop("_before", "_peak")


def metric_pack(equity: DataFrame, by: Sequence[str], order: str = "date") -> DataFrame:
    """A27. Return, CAGR, volatility, Sharpe, Sortino, drawdown and time under water of each equity curve."""
    r = F.col("ret")
    df = returns_of(equity, by, order).groupBy(*by).agg(
        F.min_by("equity", order).alias("_first"), F.max_by("equity", order).alias("_last"), F.count("ret").alias("n_returns"), F.avg("ret").alias("_mean"),
        F.stddev_samp("ret").alias("_sd"), F.stddev_samp(F.when(r < 0, r)).alias("_down"), F.min("drawdown").alias("max_drawdown"), F.avg((F.col("drawdown") < 0).cast("double")).alias("time_under_water"),
    )
    growth = F.col("_last") / F.col("_first")
    return df.select(
        *by, "n_returns", (growth - 1).alias("total_return"), (F.pow(growth, YEAR / F.greatest(F.col("n_returns"), F.lit(1))) - 1).alias("cagr"), (F.col("_sd") * YEAR**0.5).alias("annualized_volatility"),
        (F.try_divide("_mean", "_sd") * YEAR**0.5).alias("sharpe"), (F.try_divide("_mean", "_down") * YEAR**0.5).alias("sortino"), "max_drawdown", "time_under_water",
    )


def trade_metrics(trades: DataFrame, by: Sequence[str], pnl: str = "pnl") -> DataFrame:
    """A27. Count, profit factor (infinite without a loss) and expectancy."""
    x = F.col(pnl)
    gain, loss = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0)))
    return trades.groupBy(*by).agg(F.count(pnl).alias("trade_count"), F.coalesce(F.try_divide(gain, loss), F.lit(float("inf"))).alias("profit_factor"), F.avg(pnl).alias("expectancy"))


def weak_points(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """A28. One row for each issue of each curve."""
    issues = F.array_compact(F.array(*[F.when(c, n) for n, c in (("low_sharpe", F.col("sharpe") < 1), ("deep_drawdown", F.col("max_drawdown") < -0.15), ("low_profit_factor", F.col("profit_factor") < 1.2), ("long_underwater", F.col("time_under_water") > 0.65))]))
    return metrics.select(*by, F.explode(issues).alias("issue"))


def grid(results: DataFrame, rows: str, columns: str, value: str, values: Sequence | None = None) -> DataFrame:
    """A29, O10. A parameter grid: one row for each value of rows, one column for each of columns."""
    return results.groupBy(rows).pivot(columns, list(values) if values else None).agg(F.first(value))


def heatmap(trades: DataFrame, rows: str, columns: str, x: str = "ret") -> DataFrame:
    """A30, O9. Sum and hit rate for each cell, row, column and overall; ALL stands for the margin."""
    df = trades.cube(rows, columns).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.avg((F.col(x) > 0).cast("double")).alias("hit_rate"), F.grouping(rows).alias("_a"), F.grouping(columns).alias("_b"))
    name = lambda c, g: F.when(F.col(g) == 1, "ALL").otherwise(F.col(c).cast("string")).alias(c)
    return df.select(name(rows, "_a"), name(columns, "_b"), "n", "total", "hit_rate")


def risk_pack(equity: DataFrame, bench: DataFrame, by: Sequence[str], order: str = "date") -> DataFrame:
    """A31. Calmar, Omega, information ratio, tracking error, alpha, beta, ulcer and pain index, VaR, CVaR, tail ratio against bench(date, bench_ret)."""
    r = returns_of(equity, by, order).join(bench, order, "left").withColumn("active", F.col("ret") - F.col("bench_ret"))
    cut = r.groupBy(*by).agg(F.percentile("ret", 0.05).alias("value_at_risk"), F.percentile("ret", 0.95).alias("_p95"))
    x, d = F.col("ret"), F.col("drawdown")
    df = r.join(cut, list(by)).groupBy(*by, "value_at_risk", "_p95").agg(
        F.count("ret").alias("n_returns"), F.min_by("equity", order).alias("_first"), F.max_by("equity", order).alias("_last"), F.min("drawdown").alias("_dd"),
        F.try_divide(F.sum(F.when(x > 0, x)), F.abs(F.sum(F.when(x < 0, x)))).alias("omega"), (F.stddev_samp("active") * YEAR**0.5).alias("tracking_error"),
        (F.try_divide(F.avg("active"), F.stddev_samp("active")) * YEAR**0.5).alias("information_ratio"), F.try_divide(F.covar_pop("ret", "bench_ret"), F.var_pop(F.when(x.isNotNull(), F.col("bench_ret")))).alias("beta"),
        F.avg("ret").alias("_mr"), F.avg(F.when(x.isNotNull(), F.col("bench_ret"))).alias("_mb"), F.sqrt(F.avg(d * d)).alias("ulcer_index"), F.avg(F.abs(d)).alias("pain_index"), F.avg(F.when(x <= F.col("value_at_risk"), x)).alias("cvar"),
    )
    cagr = F.pow(F.col("_last") / F.col("_first"), YEAR / F.greatest(F.col("n_returns"), F.lit(1))) - 1
    return df.withColumns({"calmar": F.try_divide(cagr, F.abs("_dd")), "alpha": F.col("_mr") - F.col("beta") * F.col("_mb"), "tail_ratio": F.try_divide(F.abs("_p95"), F.abs("value_at_risk"))}).drop("_first", "_last", "_dd", "_mr", "_mb", "_p95")


def classification_pack(scores: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", cut: float = 0.5) -> DataFrame:
    """A31. Brier score, precision, recall, F1 and AUC (rank sum with average ranks for ties)."""
    w = Window.partitionBy(*by)
    rank = F.rank().over(w.orderBy(score)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, score)) - 1) / 2.0
    yes, hit = F.col(label) == 1, F.col(score) >= cut
    df = scores.withColumn("_rank", rank).groupBy(*by).agg(
        F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"), F.count_if(yes & hit).alias("_tp"), F.count_if(hit).alias("_p"), F.count_if(yes).alias("_y"), F.count_if(~yes).alias("_n"), F.sum(F.when(yes, F.col("_rank"))).alias("_ranks")
    )
    df = df.withColumns({"precision": F.try_divide("_tp", "_p"), "recall": F.try_divide("_tp", "_y"), "auc": F.try_divide(F.col("_ranks") - F.col("_y") * (F.col("_y") + 1) / 2.0, F.col("_y") * F.col("_n"))})
    return df.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("_tp", "_p", "_y", "_n", "_ranks")


def concentration_index(weights: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """A31. Herfindahl index of shares, by plain sums: exact for whole numbers, in whatever order they are added."""
    v = F.abs(value)
    return weights.groupBy(*by).agg(F.try_divide(F.sum(v * v), F.sum(v) * F.sum(v)).alias("hhi"))


def drift(df: DataFrame, feature: str, reference: Column, period: Column, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """A32. Population stability index and Kolmogorov-Smirnov distance of each period's bins against the reference rows'.

    Bins lie between percentiles of the reference; only bin counts are joined.
    """
    x = settled(df.filter(F.col(feature).isNotNull()).select(F.col(feature).alias("x"), reference.alias("ref"), period.alias("period")))
    edges = quantiles(x.filter("ref"), ["ref"], "x", [k / bins for k in range(1, bins)]).select(F.array_distinct("q").alias("e"))
    binned = x.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda e: e < F.col("x"))))
    cells = binned.groupBy("period", "bin").agg(F.count(F.lit(1)).alias("c"), F.count_if("ref").alias("r"))
    base = cells.groupBy("bin").agg(F.sum("r").alias("base"))
    n_bins = F.size("e") + 1
    wanted = binned.select("period", F.explode(F.sequence(F.lit(0), n_bins - 1)).alias("bin")).distinct()
    full = wanted.join(cells.select("period", "bin", "c"), ["period", "bin"], "left").join(base, "bin", "left").fillna(0)
    w, run = Window.partitionBy("period"), Window.partitionBy("period").orderBy("bin")
    full = full.withColumns({"p": F.col("c") / F.sum("c").over(w), "q": F.col("base") / F.sum("base").over(w)})
    a, b = F.greatest(F.col("p"), F.lit(floor)), F.greatest(F.col("q"), F.lit(floor))
    full = full.withColumns({"_psi": (a - b) * F.ln(a / b), "_ks": F.abs(F.sum("p").over(run) - F.sum("q").over(run))})
    return full.groupBy("period").agg(F.sum("c").alias("n"), F.sum("_psi").alias("psi"), F.max("_ks").alias("ks"))


def rolling_ic(df: DataFrame, feature: str, label: str, dates: int = 20) -> DataFrame:
    """A32. Cross-sectional rank IC of each date and its mean over the last dates."""
    by = Window.partitionBy("date")
    x = df.filter(F.col(feature).isNotNull() & F.col(label).isNotNull()).select("date", F.col(feature).alias("x"), F.col(label).alias("y"))
    rank = lambda c: F.rank().over(by.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("date", c)) - 1) / 2.0
    ic = x.withColumns({"rx": rank("x"), "ry": rank("y")}).groupBy("date").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("rx"), F.col("ry")).alias("ic"))
    last = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-(dates - 1), 0)
    return ic.withColumn("rolling_ic", F.avg("ic").over(last))


def screener(panel: DataFrame, windows: Sequence[int] = (5, 25, 66, 126), least_price: float = 5.0, least_dollars: float = 0.0, top: int = 5) -> DataFrame:
    """A33, O2-O4. The strongest movers of the last date: union of each horizon's top symbols, with the horizons that list them and a composite rank."""
    from qpanel.functions.windows import mean0

    df = panel.withColumns({f"_m{w}": mean0("close", w) for w in windows}).withColumn("dollars", mean0("volume", 20) * F.col("close"))
    df = df.withColumns({f"ext_{w}": F.try_divide("close", f"_m{w}") for w in windows})
    last = df.groupBy("symbol").agg(F.max_by(F.struct("date", "close", "dollars", *[f"ext_{w}" for w in windows]), "date").alias("r")).select("symbol", "r.*")
    last = last.filter((F.col("close") >= least_price) & (F.col("dollars") >= least_dollars))
    parts = [last.filter(F.col(f"ext_{w}").isNotNull()).orderBy(F.desc(f"ext_{w}"), "symbol").limit(top).select("symbol", F.lit(w).alias("source"), F.col(f"ext_{w}").alias("ext")) for w in windows]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    out = union.groupBy("symbol").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.max("ext").alias("best_extension"))
    kind = F.when(F.size("sources") == len(windows), "all_round").when(F.array_min("sources") >= 66, "long_run").when(F.array_max("sources") <= 25, "fresh").otherwise("mixed")
    return out.withColumns({"type": kind, "composite_rank": F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.size("sources").desc(), F.desc("best_extension")))})


def execution_quality(orders: DataFrame, fills: DataFrame, by: Sequence[str]) -> DataFrame:
    """A34. Rates of fills, partial fills, cancels and rejects, signed slippage in bps, shortfall and latency.

    orders(client_order_id, quantity, side, limit_price, status, sent_ts), fills(client_order_id, fill_quantity, fill_price, fill_ts):
    fills are summed per order before the join.
    """
    f = fills.groupBy("client_order_id").agg(F.sum("fill_quantity").alias("filled"), F.try_divide(F.sum(F.col("fill_quantity") * F.col("fill_price")), F.sum("fill_quantity")).alias("avg_price"), F.min("fill_ts").alias("first_fill"))
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    df = orders.join(f, "client_order_id", "left").withColumn("_slip", sign * (F.col("avg_price") / F.col("limit_price") - 1) * 1e4)
    rate = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_orders"), rate(F.coalesce(F.col("filled") >= F.col("quantity"), F.lit(False))).alias("fill_rate"), rate(F.coalesce((F.col("filled") > 0) & (F.col("filled") < F.col("quantity")), F.lit(False))).alias("partial_rate"),
        rate(F.col("status") == "cancelled").alias("cancel_rate"), rate(F.col("status") == "rejected").alias("reject_rate"), F.avg("_slip").alias("mean_slippage_bps"),
        F.sum(sign * (F.col("avg_price") - F.col("limit_price")) * F.col("filled")).alias("implementation_shortfall"), F.avg(F.unix_timestamp("first_fill") - F.unix_timestamp("sent_ts")).alias("mean_latency_s"),
    )


def autocorrelation(series: DataFrame, value: str, by: Sequence[str], lags: int = 5, order: str = "date") -> DataFrame:
    """A35. Autocorrelations 1..lags and the Newey-West t-statistic of the mean, with Bartlett weights."""
    w, whole = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    df = series.withColumn("_d", F.col(value) - F.avg(value).over(whole))
    df = df.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("_g0"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_g{k}") for k in range(1, lags + 1)])
    hac = F.col("_g0")
    for k in range(1, lags + 1):
        hac = hac + 2 * (1 - k / (lags + 1)) * F.col(f"_g{k}")
    se = F.sqrt(hac) / F.col("n")
    return g.select(*by, "n", "mean", *[F.try_divide(f"_g{k}", "_g0").alias(f"acf_{k}") for k in range(1, lags + 1)], F.when(hac > 0, F.col("mean") / se).alias("newey_west_t"))
