"""Registered queries of scoring (A1-A18), events (A19-A26, V14-V17) and validation (V1-V23), and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from qpanel.functions import binomial
from qpanel.functions.windows import by_symbol, fixed
from qpanel.operators import events, labels, lineage, residual, scoring, spec, validation
from qpanel.sources import store
from qpanel.sources.bars import table
from qpanel.sources.tables import settled

from . import features as fq
from .features import every_spec, sample
from .labels_joins import OBSERVED, observations
from .sql import BARS, W, mean0, r, ratio
from .sql import fixed as fx

QUERIES, SQL = {}, {}
#: Features whose values are the same in every engine, bit by bit, so that ranks agree.
FEATURES = ["mom_5d", "mom_20d", "rvol_20", "close_location"]
LABELS = ["forward_return_5d", "forward_return_20d"]


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


def scored_input(spark, sf_dir, names=FEATURES):
    return labels.forward_returns(spec.compute(sample(spark, sf_dir), every_spec(), names), (1, 3, 5, 10, 20))


mom = lambda k: f"CASE WHEN lag(close, {k}) OVER w > 0 THEN close / lag(close, {k}) OVER w - 1 END"
fwd = lambda k: f"CASE WHEN close > 0 THEN lead(close, {k}) OVER w / close - 1 END"
FEATS = f"""{BARS}, feats AS (
  SELECT *, {mom(5)} AS mom_5d, {mom(20)} AS mom_20d, {ratio('volume', mean0('volume', 20))} AS rvol_20, {ratio('close - low', 'high - low')} AS close_location,
         {', '.join(f'{fwd(k)} AS forward_return_{k}d' for k in (1, 3, 5, 10, 20))} FROM panel {W}
)"""
LONG = f"""{FEATS}, pairs AS (
  SELECT symbol, date, f.feature, f.x, l.label, l.y FROM feats,
    LATERAL (VALUES {', '.join(f"('{f}', {f})" for f in FEATURES)}) f(feature, x), LATERAL (VALUES {', '.join(f"('{n}', {n})" for n in LABELS)}) l(label, y)
  WHERE f.x IS NOT NULL AND l.y IS NOT NULL
)"""
KEY = "symbol, feature, label"
RANKED = f"""{LONG}, ranked AS (
  SELECT *, rank() OVER (PARTITION BY {KEY} ORDER BY x) + (count(*) OVER (PARTITION BY {KEY}, x) - 1) / 2.0::DOUBLE AS rx,
            rank() OVER (PARTITION BY {KEY} ORDER BY y) + (count(*) OVER (PARTITION BY {KEY}, y) - 1) / 2.0::DOUBLE AS ry FROM pairs
)"""
CORR = "CASE WHEN stddev_pop(rx) * stddev_pop(ry) <> 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END"
IC = f"{RANKED}, ic AS (SELECT {KEY}, count(*) AS n_obs, CASE WHEN count(*) >= 50 THEN {CORR} END AS rank_ic FROM ranked GROUP BY {KEY})"


@query("a1_feature_statistics", f"WITH {FEATS} SELECT symbol, feature, count(*) AS n_values, count(*) FILTER (v IS NULL) AS n_nan, {fx('avg(v)')} AS mean, {fx('stddev_pop(v)')} AS std FROM (SELECT symbol, f.feature, f.v FROM feats, LATERAL (VALUES {', '.join(f'({chr(39)}{f}{chr(39)}, {f})' for f in FEATURES)}) f(feature, v)) GROUP BY symbol, feature")
def statistics(spark, sf_dir):
    return scoring.statistics(scored_input(spark, sf_dir), FEATURES).select("symbol", "feature", "n_values", "n_nan", fixed("mean").alias("mean"), fixed("std").alias("std"))


@query("a3_a4_rank_ic", f"WITH {IC} SELECT {KEY}, n_obs, {fx('rank_ic')} AS rank_ic, {fx('rank_ic * sqrt((n_obs - 2) / (1 - rank_ic * rank_ic))', 5)} AS ic_t_stat FROM ic")
def rank_ic(spark, sf_dir):
    return scoring.rank_ic(scoring.pairs(scored_input(spark, sf_dir), FEATURES, LABELS)).withColumns({"rank_ic": fixed("rank_ic"), "ic_t_stat": fixed("ic_t_stat", 5)})


QS = "[" + ", ".join(f"{k / 20}" for k in range(21)) + "]"


@query("a5_mutual_information", f"WITH {LONG}, e AS (SELECT {KEY}, count(*) AS n, list_distinct(quantile_cont(x, {QS})) AS ex, list_distinct(quantile_cont(y, {QS})) AS ey FROM pairs GROUP BY {KEY}), b AS (SELECT {KEY}, n, len(list_filter(ex, lambda q: q <= x)) AS bx, len(list_filter(ey, lambda q: q <= y)) AS by_ FROM pairs JOIN e USING ({KEY})), j AS (SELECT {KEY}, n, bx, by_, count(*) AS c FROM b GROUP BY ALL), t AS (SELECT *, c / n * ln(c * n / ((sum(c) OVER (PARTITION BY {KEY}, bx)) * (sum(c) OVER (PARTITION BY {KEY}, by_)))) AS t FROM j) SELECT {KEY}, max(n) AS n_obs, {fx('CASE WHEN max(n) >= 50 THEN greatest(sum(t), 0) ELSE 0 END')} AS mutual_information FROM t GROUP BY {KEY}")
def mutual(spark, sf_dir):
    return scoring.mutual_information(scoring.pairs(scored_input(spark, sf_dir), FEATURES, LABELS)).withColumn("mutual_information", fixed("mutual_information"))


@query("a6_decile_spread", f"WITH {LONG}, e AS (SELECT {KEY}, count(*) AS n, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM pairs GROUP BY {KEY}), s AS (SELECT {KEY}, n, avg(y) FILTER (x >= hi) AS top, avg(y) FILTER (x <= lo) AS bottom FROM pairs JOIN e USING ({KEY}) GROUP BY {KEY}, n) SELECT {KEY}, n AS n_obs, {fx('top')} AS top_decile_return, {fx('bottom')} AS bottom_decile_return, {fx('top - bottom')} AS decile_spread FROM s")
def spread(spark, sf_dir):
    df = scoring.decile_spread(scoring.pairs(scored_input(spark, sf_dir), FEATURES, LABELS))
    return df.select("symbol", "feature", "label", "n_obs", *[fixed(c).alias(c) for c in ("top_decile_return", "bottom_decile_return", "decile_spread")])


@query("a7_v11_decile_table", f"WITH {LONG}, d AS (SELECT *, ntile(10) OVER (PARTITION BY feature, label ORDER BY x, symbol, date) AS decile FROM pairs), t AS (SELECT feature, label, decile, count(*) AS n, avg(y) AS mean, quantile_cont(y, 0.5) AS median, avg((y > 0)::INT) AS hit_rate FROM d GROUP BY feature, label, decile), s AS (SELECT *, sign(mean - lag(mean) OVER (PARTITION BY feature, label ORDER BY decile)) AS step FROM t) SELECT feature, label, decile, n, {fx('mean')} AS mean, {fx('median')} AS median, {fx('hit_rate')} AS hit_rate, abs(sum(step) OVER p) = 9 AS monotonic, {fx('max(CASE WHEN decile = 10 THEN mean END) OVER p - max(CASE WHEN decile = 1 THEN mean END) OVER p')} AS d10_minus_d1 FROM s WINDOW p AS (PARTITION BY feature, label)")
def deciles(spark, sf_dir):
    df = scoring.decile_table(scoring.pairs(scored_input(spark, sf_dir), FEATURES, LABELS))
    return df.select("feature", "label", "decile", "n", *[fixed(c).alias(c) for c in ("mean", "median", "hit_rate", "d10_minus_d1")], "monotonic")


SEG = f"{LONG}, seg AS (SELECT *, CAST(least(floor((row_number() OVER (PARTITION BY {KEY} ORDER BY date) - 1) / greatest(floor(count(*) OVER (PARTITION BY {KEY}) / 3), 1)), 2) AS INT) AS segment, count(*) OVER (PARTITION BY {KEY}) AS total FROM pairs), rk AS (SELECT *, rank() OVER (PARTITION BY {KEY}, segment ORDER BY x) + (count(*) OVER (PARTITION BY {KEY}, segment, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY {KEY}, segment ORDER BY y) + (count(*) OVER (PARTITION BY {KEY}, segment, y) - 1) / 2.0::DOUBLE AS ry FROM seg WHERE total >= 500), sic AS (SELECT {KEY}, segment, CASE WHEN count(*) >= 20 THEN {CORR} END AS v FROM rk GROUP BY {KEY}, segment)"


@query("a9_a10_ic_stability", f"WITH {SEG} SELECT {KEY}, count(v) AS n_segments, {fx('stddev_pop(v)')} AS ic_std, {fx('min(v)')} AS ic_min, {fx('max(v)')} AS ic_max, count(v) >= 2 AND stddev_pop(v) > 0.05 AS unstable FROM sic WHERE v IS NOT NULL GROUP BY {KEY}")
def stability(spark, sf_dir):
    df = scoring.ic_stability(scoring.pairs(scored_input(spark, sf_dir), FEATURES, LABELS))
    return df.withColumns({c: fixed(c) for c in ("ic_std", "ic_min", "ic_max")})


@query("a13_stability_score", f"WITH {FEATS}, u AS (SELECT symbol, date, f.feature, f.v FROM feats, LATERAL (VALUES {', '.join(f'({chr(39)}{f}{chr(39)}, {f})' for f in FEATURES)}) f(feature, v) WHERE f.v IS NOT NULL), s AS (SELECT *, CAST(least(floor((row_number() OVER (PARTITION BY symbol, feature ORDER BY date) - 1) / greatest(floor(count(*) OVER (PARTITION BY symbol, feature) / 3), 1)), 2) AS INT) AS segment, count(*) OVER (PARTITION BY symbol, feature) AS n FROM u), m AS (SELECT symbol, feature, n, segment, avg(v) AS m, stddev_pop(v) AS s FROM s GROUP BY ALL) SELECT symbol, feature, max(n) AS n_obs, {fx('CASE WHEN max(n) >= 60 THEN 1.0 / (1.0 + coalesce(stddev_pop(m) / nullif(abs(avg(m)), 0), 0) + coalesce(stddev_pop(s) / nullif(abs(avg(s)), 0), 0)) ELSE 0 END', 5)} AS stability FROM m GROUP BY symbol, feature")
def stability_score(spark, sf_dir):
    return scoring.stability_score(scored_input(spark, sf_dir), FEATURES).withColumn("stability", fixed("stability", 5))


@query("a8_a12_a17_validation_report")
def report(spark, sf_dir):
    """The score rows with both statuses; held by the tests against the single operators."""
    df = scoring.score(scored_input(spark, sf_dir), FEATURES, LABELS)
    return df.withColumn("extended_status", scoring.extended_status(F.col("rank_ic"), F.col("unstable"), F.col("decile_spread"), F.lit(0.001), F.lit("alpha")))


@query("a14_composite_rank")
def composite(spark, sf_dir):
    df = scored_input(spark, sf_dir)
    mi = scoring.mutual_information(scoring.pairs(df, FEATURES, LABELS[:1]))
    return scoring.composite_rank(mi, scoring.stability_score(df, FEATURES))


SCORED = f"""{IC}, e AS (
  SELECT {KEY}, count(*) AS n, list_distinct(quantile_cont(x, {QS})) AS ex, list_distinct(quantile_cont(y, {QS})) AS ey, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM pairs GROUP BY {KEY}
), b AS (SELECT {KEY}, n, len(list_filter(ex, lambda q: q <= x)) AS bx, len(list_filter(ey, lambda q: q <= y)) AS by_ FROM pairs JOIN e USING ({KEY})
), j AS (SELECT {KEY}, n, bx, by_, count(*) AS c FROM b GROUP BY ALL
), t AS (SELECT *, c / n * ln(c * n / ((sum(c) OVER (PARTITION BY {KEY}, bx)) * (sum(c) OVER (PARTITION BY {KEY}, by_)))) AS t FROM j
), mi AS (SELECT {KEY}, CASE WHEN max(n) >= 50 THEN greatest(sum(t), 0) ELSE 0 END AS mi FROM t GROUP BY {KEY}
), sp AS (SELECT {KEY}, CASE WHEN n >= 100 THEN avg(y) FILTER (x >= hi) - avg(y) FILTER (x <= lo) ELSE 0 END AS spread FROM pairs JOIN e USING ({KEY}) GROUP BY {KEY}, n
), miss AS (SELECT symbol, f.feature, avg((f.v IS NULL)::INT) AS missing FROM feats, LATERAL (VALUES {', '.join(f"('{f}', {f})" for f in FEATURES)}) f(feature, v) GROUP BY symbol, f.feature
), scored AS (
  SELECT {KEY}, n_obs, rank_ic, CASE WHEN missing > 0.5 THEN 'BLOCKED' WHEN coalesce(abs(rank_ic), 0) < 0.01 AND mi < 0.001 AND coalesce(abs(spread), 0) < 0.001 THEN 'DEAD' WHEN coalesce(abs(rank_ic), 0) < 0.02 THEN 'WEAK' ELSE 'CANDIDATE' END AS status
  FROM ic JOIN mi USING ({KEY}) JOIN sp USING ({KEY}) JOIN miss USING (symbol, feature)
)"""


@query("a15_top_candidates", f"WITH {SCORED} SELECT {KEY}, n_obs, {fx('rank_ic')} AS rank_ic, status FROM scored WHERE status IN ('CANDIDATE', 'WEAK') ORDER BY abs(rank_ic) DESC NULLS LAST, feature, label, symbol LIMIT 20")
def top(spark, sf_dir):
    scores = scoring.score(scored_input(spark, sf_dir), FEATURES, LABELS).select("symbol", "feature", "label", "n_obs", "rank_ic", "status")
    return scoring.top_candidates(scores).withColumn("rank_ic", fixed("rank_ic"))


@query("a16_run_summary", f"WITH {SCORED} SELECT count(*) AS n_pairs, count(DISTINCT feature) AS n_features, count(DISTINCT label) AS n_labels, count(*) FILTER (status = 'DEAD') AS n_dead, count(*) FILTER (status = 'BLOCKED') AS n_blocked, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses FROM scored")
def summary(spark, sf_dir):
    df = scoring.run_summary(scoring.score(scored_input(spark, sf_dir), FEATURES, LABELS))
    return df.withColumn("statuses", F.array_join("statuses", ","))


# all features against all labels: beyond SQL's reach on whole tables; the tests hold them against the single operators
def all_labels() -> list[str]:
    return [f"{kind}_{k}d" for kind in ("forward_return", "log_forward_return", "excess_vs_market", "excess_vs_sector") for k in (1, 3, 5, 10, 20)] + ["triple_barrier"]


def numeric(df, names=None) -> list[str]:
    """The features that are numbers; ladders with names are not scored."""
    kinds = dict(df.dtypes)
    return [n for n in names or fq.feature_names() if kinds[n] != "string"]


def full_input(spark, sf_dir):
    """Every feature and label of every bar, as a table."""
    p = sample(spark, sf_dir)
    market = p.groupBy("date").agg(F.avg("close").alias("level"))
    sector = p.groupBy(residual.sector_of(F.col("symbol")).alias("_sector"), "date").agg(F.avg("close").alias("level"))
    f = fq.features(spark, sf_dir, fq.feature_names())
    df = labels.triple_barrier(labels.forward_returns(f)).withColumn("_sector", residual.sector_of(F.col("symbol")))
    df = labels.excess_returns(df, market, ["date"], "level", "market")
    df = labels.excess_returns(df, sector, ["_sector", "date"], "level", "sector")
    return settled(df.select("symbol", "date", "i", *fq.feature_names(), *all_labels()))


@query("a1_a16_all_scores")
def every_score(spark, sf_dir):
    df = full_input(spark, sf_dir)
    return scoring.all_scores(df, numeric(df), all_labels())


@query("a14_v3_v4_clusters")
def clusters(spark, sf_dir):
    """Features that say the same, and of each such cluster the one to keep: by variance, and by IC, stability and completeness."""
    df = full_input(spark, sf_dir)
    names = numeric(df)
    rows = validation.cluster_rows(validation.wide_correlations(df, names), names)
    merits = scoring.feature_merits(scoring.all_scores(df, names, all_labels()))
    merits = merits.select("feature", F.coalesce("ic", F.lit(0.0)).alias("ic"), (1 - F.col("unstable_share")).alias("stability"), "missing_rate")
    best = validation.representative(merits, rows.select("cluster", "feature")).withColumnRenamed("representative", "by_merit")
    return rows.join(best, "cluster").join(merits, "feature")


def cut_and_whole(spark, sf_dir, names, whole=None):
    """Features of the bars up to the middle date, from the whole history (whole, if it is at hand) and from that part alone."""
    whole = fq.features(spark, sf_dir, names).select("symbol", "date", *names) if whole is None else whole
    p = fq.joined_panel(spark, sf_dir)
    middle = p.agg(F.to_date(F.timestamp_seconds(F.percentile(F.unix_seconds(F.col("date").cast("timestamp")), 0.5).cast("long")))).first()[0]
    return whole, spec.compute(p.filter(F.col("date") <= F.lit(middle)), every_spec(), names)


@query("v7_full_lookahead")
def full_lookahead(spark, sf_dir):
    """Every feature, recursive and fitted ones included, with and without the second half of the history."""
    whole, cut = cut_and_whole(spark, sf_dir, fq.feature_names())
    return validation.lookahead_test(whole, cut, numeric(whole))


@query("a17_validation_report")
def full_report(spark, sf_dir):
    df = full_input(spark, sf_dir)
    names = numeric(df)
    scores = settled(scoring.all_scores(df, names, all_labels()))
    rows = validation.cluster_rows(validation.wide_correlations(df, names), names)
    differ = validation.lookahead_test(*cut_and_whole(spark, sf_dir, names, df), names).agg(F.sum("n_differ")).first()[0] or 0
    report = scoring.validation_report(scores, rows, differ)
    return report.withColumns({c: F.array_join(c, ",") for c in ("top", "dead", "unstable")})


def pr(f):
    return f"CASE WHEN {f} IS NOT NULL THEN percent_rank() OVER (PARTITION BY symbol, {f} IS NOT NULL ORDER BY {f}) END"


def z(f):
    return f"({f} - avg({f}) OVER s) / nullif(stddev_pop({f}) OVER s, 0)"


@query("a18_set_composites", f"WITH {FEATS}, t AS (SELECT symbol, date, mom_5d, -mom_20d AS mom_20d, rvol_20 FROM feats) SELECT symbol, date, {fx(f'({pr("mom_5d")} + {pr("mom_20d")}) / 2')} AS momentum_rank_average, {fx(f'({pr("mom_5d")} + {pr("rvol_20")}) / 2')} AS activity_rank_average, {fx(f'({z("mom_5d")} + {z("mom_20d")}) / 2')} AS momentum_z_average, {fx(f'({z("mom_5d")} + {z("rvol_20")}) / 2')} AS activity_z_average FROM t WINDOW s AS (PARTITION BY symbol)")
def composites(spark, sf_dir):
    df = scoring.set_composites(scored_input(spark, sf_dir), {"momentum": ["mom_5d", "mom_20d"], "activity": ["mom_5d", "rvol_20"]}, {"mom_20d": -1})
    return df.select("symbol", "date", *[fixed(c).alias(c) for c in df.columns[2:]])


# events
SIG = f"{FEATS}, sig AS (SELECT *, CASE WHEN mom_5d < -0.2 THEN 'deep' END AS v1, CASE WHEN mom_5d < 0 THEN 'any' END AS v2 FROM feats), variants AS (SELECT *, v1 AS variant FROM sig WHERE v1 IS NOT NULL UNION ALL SELECT *, v2 FROM sig WHERE v2 IS NOT NULL)"


def variant_signals(spark, sf_dir):
    found = F.array_compact(F.array(F.when(F.col("mom_5d") < -0.2, "deep"), F.when(F.col("mom_5d") < 0, "any")))
    return scored_input(spark, sf_dir).withColumn("variant", F.explode(found))


@query("a19_event_study", f"WITH {SIG}, u AS (SELECT variant, h.horizon, h.ret FROM variants, LATERAL (VALUES (1, forward_return_1d), (3, forward_return_3d), (5, forward_return_5d), (10, forward_return_10d), (20, forward_return_20d)) h(horizon, ret) WHERE h.ret IS NOT NULL) SELECT variant, horizon, count(ret) AS n, {fx('avg(ret)')} AS mean, {fx('quantile_cont(ret, 0.5)')} AS median, {fx('avg((ret > 0)::INT)')} AS hit_rate, {fx('avg(ret) - 0.001::DOUBLE')} AS net_mean FROM u GROUP BY variant, horizon")
def study(spark, sf_dir):
    df = events.event_study(variant_signals(spark, sf_dir), ["variant"])
    return df.select("variant", "horizon", "n", *[fixed(c).alias(c) for c in ("mean", "median", "hit_rate", "net_mean")])


@query("a20_horizon_costs", f"WITH {SIG}, u AS (SELECT h.horizon, avg(h.ret) * 1e4 AS spread_bps FROM variants, LATERAL (VALUES (1, forward_return_1d), (5, forward_return_5d), (20, forward_return_20d)) h(horizon, ret) WHERE variant = 'deep' GROUP BY h.horizon), m(horizon, rebalances) AS (VALUES (1, 252), (3, 84), (5, 50), (10, 25), (20, 12)), c(cost_bps) AS (VALUES (10), (5), (2)) SELECT horizon, cost_bps, rebalances, {fx('spread_bps', 2)} AS spread_bps, rebalances * cost_bps AS annual_cost_bps, {fx('spread_bps - rebalances * cost_bps', 2)} AS adjusted_bps, spread_bps > cost_bps AS survives FROM u JOIN m USING (horizon) CROSS JOIN c")
def costs(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"forward_return_{h}d").alias("ret")) for h in (1, 5, 20)])
    s = variant_signals(spark, sf_dir).filter("variant = 'deep'").select(F.explode(rows).alias("r")).select("r.*").groupBy("horizon").agg((F.avg("ret") * 1e4).alias("spread_bps"))
    return events.horizon_costs(s, spark).withColumns({"spread_bps": fixed("spread_bps", 2), "adjusted_bps": fixed("adjusted_bps", 2)})


@query("a21_a22_filter_test", f"WITH {SIG}, b AS (SELECT variant, forward_return_5d AS ret, rvol_20 > 1.5 AS k1, close_location > 0.5 AS k2 FROM variants), g AS (SELECT variant, count(ret) AS base_n, avg(ret) AS base_mean, avg((ret > 0)::INT) AS base_hit, count(ret) FILTER (k1) AS n1, avg(ret) FILTER (k1) AS m1, avg((ret > 0)::INT) FILTER (k1) AS h1, count(ret) FILTER (k2) AS n2, avg(ret) FILTER (k2) AS m2, avg((ret > 0)::INT) FILTER (k2) AS h2 FROM b GROUP BY variant), l AS (SELECT variant, base_n, base_mean, base_hit, 'busy' AS filter, n1 AS n, m1 AS mean, h1 AS hit_rate FROM g UNION ALL SELECT variant, base_n, base_mean, base_hit, 'strong_close', n2, m2, h2 FROM g) SELECT variant, base_n, {fx('base_mean')} AS base_mean, {fx('base_hit')} AS base_hit, filter, n, {fx('mean')} AS mean, {fx('hit_rate')} AS hit_rate, {fx('1 - n / base_n')} AS trade_reduction, {fx('mean - base_mean')} AS improvement, CASE WHEN n < 50 THEN 'BLOCKED_SMALL_SAMPLE' WHEN mean - base_mean > 0 THEN 'IMPROVES' ELSE 'NO_IMPROVEMENT' END AS status FROM l")
def filters(spark, sf_dir):
    df = variant_signals(spark, sf_dir).withColumn("ret", F.col("forward_return_5d"))
    out = events.filter_test(df, {"busy": F.col("rvol_20") > 1.5, "strong_close": F.col("close_location") > 0.5}, ["variant"])
    return out.withColumns({c: fixed(c) for c in ("base_mean", "base_hit", "mean", "hit_rate", "trade_reduction", "improvement")})


SECTOR_SQL = "CAST(CAST(regexp_extract(symbol, '([0-9]+)', 1) AS INT) % 5 AS VARCHAR)"


@query("a23_segments", f"WITH {SIG}, b AS (SELECT CAST(year(date) AS VARCHAR) AS y, CASE WHEN mom_20d > 0 THEN 'up' WHEN mom_20d IS NOT NULL THEN 'down' END AS g, {SECTOR_SQL} AS s, forward_return_5d AS ret FROM variants WHERE variant = 'any'), u AS (SELECT 'year' AS segment, y AS value, ret FROM b UNION ALL SELECT 'regime', g, ret FROM b UNION ALL SELECT 'sector', s, ret FROM b) SELECT segment, value, count(ret) AS n, {fx('avg(ret)')} AS mean, {fx('avg((ret > 0)::INT)')} AS hit_rate, CASE WHEN count(ret) < 50 THEN 'BLOCKED_SMALL_SAMPLE' ELSE 'OK' END AS status FROM u GROUP BY segment, value")
def segmented(spark, sf_dir):
    df = variant_signals(spark, sf_dir).filter("variant = 'any'")
    df = df.select(F.year("date").alias("year"), F.when(F.col("mom_20d") > 0, "up").when(F.col("mom_20d").isNotNull(), "down").alias("regime"), residual.sector_of(F.col("symbol")).alias("sector"), F.col("forward_return_5d").alias("ret"))
    return events.segments(df).withColumns({"mean": fixed("mean"), "hit_rate": fixed("hit_rate")})


@query("a24_distribution", f"WITH {SIG}, b AS (SELECT symbol, forward_return_5d AS ret FROM variants WHERE variant = 'any' AND forward_return_5d IS NOT NULL), c AS (SELECT symbol, quantile_cont(ret, 0.9) AS p90, avg(ret) AS m FROM b GROUP BY symbol), k AS (SELECT b.*, p90, ret - m AS d FROM b JOIN c USING (symbol)) SELECT symbol, count(ret) AS n, {fx('avg(ret)')} AS mean, {fx('quantile_cont(ret, 0.5)')} AS median, {fx('avg(d * d * d) / pow(avg(d * d), 1.5)', 4)} AS skew, {fx('avg(d * d * d * d) / pow(avg(d * d), 2)', 4)} AS kurtosis, {fx('sum(ret) FILTER (ret > 0) / abs(sum(ret) FILTER (ret < 0))')} AS profit_factor, {fx('sum(ret) FILTER (ret >= p90) / sum(ret) FILTER (ret > 0)')} AS top_tenth_share, {fx('quantile_cont(ret, 0.01)')} AS worst_hundredth FROM k GROUP BY symbol")
def distribution(spark, sf_dir):
    df = variant_signals(spark, sf_dir).filter("variant = 'any'").withColumn("ret", F.col("forward_return_5d")).filter("ret IS NOT NULL")
    out = events.distribution(df)
    return out.select("symbol", "n", *[fixed(c, 4 if c in ("skew", "kurtosis") else 6).alias(c) for c in out.columns[2:]])


@query("a25_concentration", f"WITH {IC}, k AS (SELECT feature, symbol, abs(rank_ic) AS a, row_number() OVER (PARTITION BY feature ORDER BY abs(rank_ic) DESC, symbol) AS n FROM ic WHERE label = 'forward_return_5d' AND rank_ic IS NOT NULL) SELECT feature, count(*) AS n_symbols, {fx('sum(a) FILTER (n <= 3) / sum(a)')} AS top_share, {fx('avg(a)')} AS mean_abs_ic FROM k GROUP BY feature")
def concentrated(spark, sf_dir):
    ic = scoring.rank_ic(scoring.pairs(scored_input(spark, sf_dir), FEATURES, LABELS[:1])).withColumn("ic", F.col("rank_ic"))
    return events.concentration(ic).withColumns({"top_share": fixed("top_share"), "mean_abs_ic": fixed("mean_abs_ic")})


RFEATS = ["residual_r2", "residual_beta", "residual_z", "residual_half_life", "regime_score"]


@query("w47_a26_v16_fit_class_events")
def fit_events(spark, sf_dir):
    """Residual signals by fit class: rests on the half-life recursion, which SQL does not state."""
    f = labels.forward_returns(fq.features(spark, sf_dir, RFEATS), (5,))
    fits = residual.fit_quality(f)
    return events.by_fit_class(events.residual_signals(f).withColumn("ret", F.col("forward_return_5d")), fits)


@query("v17_latest_signals", f"WITH {BARS}, f AS (SELECT symbol, date, CASE WHEN i >= 5 THEN avg(close) OVER {r(5)} END AS fast_ma, CASE WHEN i >= 20 THEN avg(close) OVER {r(20)} END AS slow_ma, CASE WHEN i >= 10 THEN close / (max(close) OVER {r(10)}) - 1 END AS pullback, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM panel {W}), s AS (SELECT *, CASE WHEN fast_ma > slow_ma THEN 0.3 ELSE 0.0 END::DOUBLE + CASE WHEN pullback < -0.01 THEN 0.2 ELSE 0.0 END::DOUBLE AS score FROM f WHERE back = 1 AND fast_ma IS NOT NULL AND slow_ma IS NOT NULL) SELECT symbol, date, score, CASE WHEN score >= 0.4 THEN 'long' ELSE 'flat' END AS direction, concat_ws(',', CASE WHEN fast_ma > slow_ma THEN 'trend_positive' END, CASE WHEN pullback < -0.01 THEN 'short_pullback' END) AS reason_codes FROM s")
def latest(spark, sf_dir):
    df = events.latest_signals(events.pullback_features(sample(spark, sf_dir)))
    return df.select("symbol", "date", "score", "direction", F.array_join("reason_codes", ",").alias("reason_codes"))


@query("v17_base_signals")
def base(spark, sf_dir):
    f = labels.forward_returns(fq.features(spark, sf_dir, ["rsi_2", "hurst_100", "regime_score"]), (5,)).withColumn("ret", F.col("forward_return_5d"))
    return events.event_stats(settled(events.base_signals(f).select("strategy", "ret")), ["strategy"])


FLAGS = f"""{BARS}, fl0 AS (
  SELECT *, CASE WHEN lag(close) OVER w > 0 THEN open / lag(close) OVER w - 1 END AS gap, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr, {mean0('volume', 20)} AS v20 FROM panel {W}
), fl1 AS (SELECT *, {mean0('tr', 20)} AS tr20 FROM fl0 {W}
), flags AS (SELECT *, coalesce(gap <= -0.05, false) AS gap_down, coalesce(gap >= 0.05, false) AS gap_up, coalesce(volume / v20 >= 3, false) AS volume_spike, abs(returns) >= 0.05 AS extreme_return, coalesce(tr / tr20 >= 2.5, false) AS wide_range FROM fl1)"""


@query("v14_event_flags", f"WITH {FLAGS} SELECT symbol, count(*) AS n, count(*) FILTER (gap_down) AS gap_down, count(*) FILTER (gap_up) AS gap_up, count(*) FILTER (volume_spike) AS volume_spike, count(*) FILTER (extreme_return) AS extreme_return, count(*) FILTER (wide_range) AS wide_range FROM flags GROUP BY symbol")
def flags(spark, sf_dir):
    names = ["gap_down", "gap_up", "volume_spike", "extreme_return", "wide_range"]
    return validation.event_flags(sample(spark, sf_dir)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(n).alias(n) for n in names])


@query("v15_event_block_test", f"WITH {FLAGS}, q AS (SELECT *, {fwd(5)} AS ret, {mom(5)} AS m FROM flags {W}), b AS (SELECT * FROM q WHERE m < -0.2), l AS (SELECT 'no_gap_down' AS filter, NOT gap_down AS keep, ret FROM b UNION ALL SELECT 'no_vol_spike', NOT volume_spike, ret FROM b UNION ALL SELECT 'no_extreme_ret', NOT extreme_return, ret FROM b UNION ALL SELECT 'no_any_event', NOT (gap_down OR gap_up OR volume_spike OR extreme_return OR wide_range), ret FROM b) SELECT filter, count(ret) AS base_n, {fx('avg(ret)')} AS base_mean, count(ret) FILTER (keep) AS n, {fx('avg(ret) FILTER (keep)')} AS mean FROM l GROUP BY filter")
def blocks(spark, sf_dir):
    df = labels.forward_returns(validation.event_flags(spec.compute(sample(spark, sf_dir), every_spec(), ["mom_5d"])), (5,)).filter("mom_5d < -0.2")
    any_event = F.col("gap_down") | F.col("gap_up") | F.col("volume_spike") | F.col("extreme_return") | F.col("wide_range")
    tests = {"no_gap_down": ~F.col("gap_down"), "no_vol_spike": ~F.col("volume_spike"), "no_extreme_ret": ~F.col("extreme_return"), "no_any_event": ~any_event}
    out = events.filter_test(df.withColumns({"ret": F.col("forward_return_5d"), "strategy": F.lit("reversal")}), tests)
    return out.select("filter", "base_n", fixed("base_mean").alias("base_mean"), "n", fixed("mean").alias("mean"))


# validation
@query("v1_leakage_audit")
def leakage(spark, sf_dir):
    """Each feature's lineage against the loaded registry; what Python makes, which no plan shows, by its values with and without the second half of the history."""
    names = fq.feature_names()
    read = lineage.lineage(fq.features(spark, sf_dir, names), names)
    dark = [r["feature"] for r in read.filter("opaque").select("feature").collect()]
    return lineage.leakage_audit(read, store.loaded_registry(spark), validation.lookahead_test(*cut_and_whole(spark, sf_dir, dark), dark))


def planted(panel):
    """Features that are sound, that read later bars (at once, by a centred window, through two others, from the whole history), and one whose way into the future is taken back."""
    w = by_symbol()
    nxt = F.lead("close").over(w)
    df = spec.compute(panel, every_spec(), ["mom_5d", "rvol_20"]).withColumn("_step", F.when(F.col("close") > 0, nxt / F.col("close") - 1))
    df = df.withColumn("_mean", F.avg("_step").over(w.rowsBetween(-2, 0)))
    return df.withColumns({
        "peek_direct": F.col("_step"), "peek_centred": F.avg("close").over(w.rowsBetween(-2, 2)), "peek_chain": F.col("_mean") * 2, "peek_whole": F.col("close") - F.avg("close").over(Window.partitionBy("symbol")),
        "peek_undone": F.lag("_step").over(w),
    })


PLANTED = ["mom_5d", "rvol_20", "peek_direct", "peek_centred", "peek_chain", "peek_whole", "peek_undone"]


def planted_sql(name, source):
    return f"""{name}_1 AS (SELECT *, {mom(5)} AS mom_5d, {ratio('volume', mean0('volume', 20))} AS rvol_20, CASE WHEN close > 0 THEN lead(close) OVER w / close - 1 END AS step, avg(close) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS peek_centred,
    close - avg(close) OVER (PARTITION BY symbol) AS peek_whole FROM {source} {W}),
    {name} AS (SELECT *, step AS peek_direct, 2 * avg(step) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS peek_chain, lag(step) OVER w AS peek_undone FROM {name}_1 {W})"""


# the SQL reads no plan: it computes the features with and without the later half of all bars, and blocks those whose values differ
@query("v1_planted_leaks", f"""WITH {BARS}, half AS (SELECT * FROM panel WHERE date <= (SELECT quantile_disc(date, 0.5) FROM panel)), {planted_sql('full_', 'panel')}, {planted_sql('cut_', 'half')}, u AS (
    SELECT v.feature, v.a, v.b FROM cut_ JOIN full_ USING (symbol, date), LATERAL (VALUES {', '.join(f"('{f}', full_.{f}, cut_.{f})" for f in PLANTED)}) v(feature, a, b)
  ), d AS (SELECT feature, bool_or(a IS DISTINCT FROM b AND NOT coalesce(abs(a - b) <= 1e-9 * greatest(abs(a), 1), false)) AS differs FROM u GROUP BY feature
  ), n AS (SELECT v.feature, count(v.x) AS n_values FROM full_, LATERAL (VALUES {', '.join(f"('{f}', {f})" for f in PLANTED)}) v(feature, x) GROUP BY v.feature)
  SELECT feature, n_values, CASE WHEN differs THEN 'reads_future' ELSE '' END AS failed, CASE WHEN differs THEN 'BLOCKED_LEAKAGE' ELSE 'PASS' END AS verdict FROM d JOIN n USING (feature)""")  # fmt: skip
def planted_leaks(spark, sf_dir):
    """Planted features, all registered as safe, judged by their lineage alone."""
    df = planted(sample(spark, sf_dir))
    reg = store.loaded_registry(spark)
    claims = reg.filter("feature = 'mom_5d'").withColumn("feature", F.explode(F.array(*[F.lit(n) for n in PLANTED[2:]])))
    counts = df.select(*[F.count(n).alias(n) for n in PLANTED]).unpivot([], PLANTED, "feature", "n_values")
    return lineage.leakage_audit(lineage.lineage(df, PLANTED), reg.unionByName(claims)).join(counts, "feature").select("feature", "n_values", "failed", "verdict")


@query("v2_full_warmup")
def full_warmup(spark, sf_dir):
    df = fq.features(spark, sf_dir, fq.feature_names())
    return validation.warmup_audit(df, store.registry(spark, every_spec()), numeric(df))


@query("v2_warmup_audit", f"WITH {FEATS}, u AS (SELECT f.feature, f.lookback, i, f.v FROM feats, LATERAL (VALUES ('mom_5d', 6, mom_5d), ('mom_20d', 21, mom_20d), ('rvol_20', 20, rvol_20), ('close_location', 1, close_location)) f(feature, lookback, v)), g AS (SELECT feature, lookback, count(*) FILTER (i < lookback AND v IS NULL) AS expected_nan, count(*) FILTER (i >= lookback AND v IS NULL) AS unexpected_nan, count(*) FILTER (i >= lookback) AS n_after FROM u GROUP BY feature, lookback) SELECT feature, lookback, expected_nan, unexpected_nan, n_after, {fx('unexpected_nan / n_after')} AS unexpected_rate, CASE WHEN unexpected_nan / n_after <= 0.05 THEN 'WARMUP_ONLY' ELSE 'UNEXPECTED_NAN' END AS verdict FROM g")
def warmup(spark, sf_dir):
    return validation.warmup_audit(scored_input(spark, sf_dir), store.registry(spark, every_spec()), FEATURES).withColumn("unexpected_rate", fixed("unexpected_rate"))


CPAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query("v3_j10_correlation_matrix", f"WITH {FEATS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {fx(f'covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))')} AS r FROM feats WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in CPAIRS))
def correlation(spark, sf_dir):
    return validation.correlation_pairs(scored_input(spark, sf_dir), FEATURES).withColumn("r", fixed("r"))


@query("v5_v6_purged_cv", f"WITH {BARS}, n AS (SELECT min(k) AS n FROM (SELECT count(*) AS k FROM panel GROUP BY symbol)), s AS (SELECT CAST(s AS INT) AS split, n - (5 - s) * (n // 6) AS test_start, n // 6 AS size FROM n, range(5) t(s)), b AS (SELECT split, 'train' AS role, 1 AS lo, test_start - 40 AS hi FROM s WHERE test_start - 40 >= 20 UNION ALL SELECT split, 'test', test_start + 1, test_start + size FROM s WHERE test_start - 40 >= 20) SELECT split, role, symbol, count(*) AS n_bars, min(date) AS first_date, max(date) AS last_date FROM panel JOIN b ON i BETWEEN lo AND hi GROUP BY split, role, symbol")
def purged(spark, sf_dir):
    p = sample(spark, sf_dir)
    n = p.groupBy("symbol").count().agg(F.min("count")).first()[0] or 0
    return validation.assign_splits(p, validation.purged_splits(spark, n)).groupBy("split", "role", "symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


FEATURES_SQL = f"{mom(5)} AS mom_5d, {mom(20)} AS mom_20d, {ratio('volume', mean0('volume', 20))} AS rvol_20, {ratio('close - low', 'high - low')} AS close_location"
DIFFER = "count(*) FILTER (a IS DISTINCT FROM b AND NOT coalesce(abs(a - b) <= 1e-9 * greatest(abs(a), 1), false))"


@query("v7_lookahead_test", f"WITH {FEATS}, cut AS (SELECT symbol, date, {FEATURES_SQL} FROM panel WHERE date < DATE '1998-01-01' {W}), u AS (SELECT v.feature, v.a, v.b FROM cut JOIN feats USING (symbol, date), LATERAL (VALUES {', '.join(f'({chr(39)}{f}{chr(39)}, feats.{f}, cut.{f})' for f in FEATURES)}) v(feature, a, b)) SELECT feature, count(*) AS n, {DIFFER} AS n_differ, {DIFFER} = 0 AS passed FROM u GROUP BY feature")
def lookahead(spark, sf_dir):
    p = sample(spark, sf_dir)
    cut = p.filter(F.col("date") < F.to_date(F.lit("1998-01-01")))
    return validation.lookahead_test(spec.compute(p, every_spec(), FEATURES), spec.compute(cut, every_spec(), FEATURES), FEATURES)


DRAW = lambda seed, *cols: f"CAST('0x' || substr(md5('{seed}' || {' || '.join(chr(39) + ':' + chr(39) + ' || CAST(' + c + ' AS VARCHAR)' for c in cols)}), 1, 13) AS BIGINT)"


ALL_FORWARD = [f"forward_return_{k}d" for k in (1, 3, 5, 10, 20)]


@query("v8_null_baseline", f"WITH {FEATS}, l AS (SELECT symbol, date, mom_5d AS x, l.label, l.y FROM feats, LATERAL (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {n})' for n in ALL_FORWARD)}) l(label, y) WHERE mom_5d IS NOT NULL AND l.y IS NOT NULL), x AS (SELECT symbol, date, label, rank() OVER (PARTITION BY symbol, label ORDER BY x) AS rx, rank() OVER (PARTITION BY symbol, label ORDER BY y) AS ry, row_number() OVER (PARTITION BY symbol, label ORDER BY date) AS place FROM l), m AS (SELECT x.*, p.perm FROM x, range(1, 21) p(perm)), t AS (SELECT *, row_number() OVER (PARTITION BY symbol, label, perm ORDER BY {DRAW('null', 'perm', 'symbol', 'date')}, date) AS turn FROM m), c AS (SELECT a.label, 'shuffled_label' AS baseline, abs(corr(a.rx, b.ry)) AS ic FROM t a JOIN t b ON a.symbol = b.symbol AND a.label = b.label AND a.perm = b.perm AND a.place = b.turn GROUP BY a.symbol, a.label, a.perm UNION ALL SELECT label, 'random_feature', abs(corr(turn, ry)) FROM t GROUP BY symbol, label, perm) SELECT label, baseline, count(ic) AS n, {fx('avg(ic)')} AS mean_abs_ic, {fx('stddev_pop(ic)')} AS std_abs_ic, {fx('quantile_cont(ic, 0.95)')} AS p95_abs_ic FROM c GROUP BY label, baseline")
def null_baseline(spark, sf_dir):
    df = validation.null_baselines(scored_input(spark, sf_dir), "mom_5d", ALL_FORWARD)
    return df.withColumns({c: fixed(c) for c in ("mean_abs_ic", "std_abs_ic", "p95_abs_ic")})


PRUNED = f"{SIG}, pool AS (SELECT variant AS strategy, symbol, date, forward_return_5d AS ret, rvol_20 > 1.5 AS keep FROM variants WHERE forward_return_5d IS NOT NULL), a AS (SELECT strategy, count(*) FILTER (keep) AS k, avg(ret) FILTER (keep) AS filtered_mean FROM pool GROUP BY strategy)"


def drawn(perms):
    return f"{PRUNED}, d AS (SELECT pool.*, perm, row_number() OVER (PARTITION BY strategy, perm ORDER BY {DRAW('prune', 'perm', 'symbol', 'date')}, symbol, date) AS n FROM pool, range(1, {perms + 1}) p(perm)), m AS (SELECT strategy, perm, avg(ret) AS v FROM d JOIN a USING (strategy) WHERE n <= k GROUP BY strategy, perm)"


VERDICT = "CASE WHEN filtered_mean > p95 THEN 'BEATS' WHEN filtered_mean > p50 THEN 'BORDERLINE' ELSE 'FAILS' END"
QUANTILES = "quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99"


def pruned(spark, sf_dir):
    """The pool of each strategy, with the size of what its filter keeps, and the mean of that."""
    pool = variant_signals(spark, sf_dir).select(F.col("variant").alias("strategy"), "symbol", "date", F.col("forward_return_5d").alias("ret"), (F.col("rvol_20") > 1.5).alias("keep")).filter("ret IS NOT NULL")
    actual = pool.groupBy("strategy").agg(F.count_if("keep").alias("_k"), F.avg(F.when(F.col("keep"), F.col("ret"))).alias("filtered_mean"))
    return pool.join(F.broadcast(actual.select("strategy", "_k")), "strategy"), actual.drop("_k")


@query("v9_random_pruning", f"WITH {drawn(250)}, q AS (SELECT strategy, {QUANTILES} FROM m GROUP BY strategy) SELECT strategy, {fx('filtered_mean')} AS filtered_mean, {fx('p50')} AS p50, {fx('p95')} AS p95, {fx('p99')} AS p99, {VERDICT} AS verdict FROM a JOIN q USING (strategy)")
def pruning(spark, sf_dir):
    pool, actual = pruned(spark, sf_dir)
    return validation.pruning_verdict(validation.random_pruning(pool, F.col("_k")), actual).withColumns({c: fixed(c) for c in ("filtered_mean", "p50", "p95", "p99")})


@query("v9_two_stage_pruning", f"WITH {drawn(750)}, q1 AS (SELECT strategy, {QUANTILES} FROM m WHERE perm <= 250 GROUP BY strategy), s1 AS (SELECT strategy, {VERDICT} AS first_verdict FROM a JOIN q1 USING (strategy)), q AS (SELECT strategy, first_verdict, {QUANTILES}, count(*) AS perms FROM m JOIN s1 USING (strategy) WHERE perm <= 250 OR first_verdict <> 'FAILS' GROUP BY strategy, first_verdict) SELECT strategy, first_verdict, perms, {fx('filtered_mean')} AS filtered_mean, {fx('p50')} AS p50, {fx('p95')} AS p95, {fx('p99')} AS p99, {VERDICT} AS verdict FROM a JOIN q USING (strategy)")
def pruning_in_two_stages(spark, sf_dir):
    pool, actual = pruned(spark, sf_dir)
    return validation.two_stage_pruning(pool, F.col("_k"), actual).withColumns({c: fixed(c) for c in ("filtered_mean", "p50", "p95", "p99")})


@query("v10_v13_subset_audit", f"WITH {SIG}, b AS (SELECT symbol, date FROM sig WHERE v2 IS NOT NULL), f AS (SELECT symbol, date FROM sig WHERE v1 IS NOT NULL) SELECT (SELECT count(*) FROM b) AS n_base, (SELECT count(*) FROM f) AS n_filtered, (SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM b)) AS n_new, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM f)) AS n_removed, 0::BIGINT AS n_repeated, 'PURE_FILTER' AS verdict")
def subsets(spark, sf_dir):
    df = scored_input(spark, sf_dir)
    return validation.subset_audit(df.filter("mom_5d < 0"), df.filter("mom_5d < -0.2"))


@query("v12_duplicate_results", "WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS strategy, count(*) AS n_obs, count(*) FILTER (o_orderstatus = 'F') AS n_done FROM orders GROUP BY o_custkey), k AS (SELECT *, count(*) OVER p AS n, min(strategy) OVER p AS same_as FROM g WINDOW p AS (PARTITION BY n_obs, n_done)) SELECT n_obs, n_done, strategy, same_as, n FROM k WHERE n > 1")
def duplicates(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("strategy")).agg(F.count(F.lit(1)).alias("n_obs"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))
    return validation.duplicate_results(g, ["n_obs", "n_done"])


LEDGER = f"{OBSERVED}, ledger AS (SELECT observation_id, symbol, CASE WHEN status = 'O' THEN 'PENDING' ELSE 'RESOLVED' END AS outcome_status, CASE WHEN status = 'P' THEN 'yes' ELSE 'false' END AS sent_to_broker, CASE WHEN status = 'P' THEN 'x1' ELSE 'None' END AS broker_order_id FROM obs)"


def ledger(spark, sf_dir):
    o = observations(spark, sf_dir)
    s = F.col("status")
    return o.select("observation_id", "symbol", "signal_date", "amount", F.when(s == "O", "PENDING").otherwise("RESOLVED").alias("outcome_status"), F.when(s == "P", "yes").otherwise("false").alias("sent_to_broker"), F.when(s == "P", "x1").otherwise("None").alias("broker_order_id"))


@query("v18_p10_p11_ledger_invariants", f"WITH {LEDGER} SELECT count(*) AS total, count(*) FILTER (outcome_status = 'PENDING') AS pending, count(*) FILTER (outcome_status <> 'PENDING') AS resolved, count(*) - count(DISTINCT observation_id) AS duplicate_ids, count(*) FILTER (sent_to_broker = 'yes') AS sent, count(*) FILTER (broker_order_id = 'x1') AS with_order, count(*) AS outcomes, true AS same_rows, 0 AS symbols_apart FROM ledger")
def invariants(spark, sf_dir):
    df = ledger(spark, sf_dir)
    return validation.ledger_invariants(df, df.select("symbol", "sent_to_broker"))


TOKENS = ("guaranteed", "license", "password", "idiot", "the the")


@query("v19_forbidden_language", "SELECT doc_id, t.token FROM documents, LATERAL (VALUES " + ", ".join(f"('{t}')" for t in TOKENS) + ") t(token) WHERE contains(lower(text), t.token)")
def forbidden(spark, sf_dir):
    return validation.forbidden_language(table(spark, sf_dir, "documents"), TOKENS)


def tail_sql(k, p):
    """The chance of k hits or more, as a plain sum."""
    return f"coalesce(list_sum(list_transform(range({k}, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})))), 0)"


@query("v20_hit_rates", f"""WITH RECURSIVE {FEATS}, g AS (SELECT symbol, mom_5d > 0 AS rising, count(*) AS n, count(*) FILTER (forward_return_5d > 0) AS k FROM feats WHERE mom_5d IS NOT NULL AND forward_return_5d IS NOT NULL GROUP BY ALL
  ), walk(symbol, rising, n, k, step, l1, l2, h1, h2) AS (
    SELECT symbol, rising, n, k, 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM g
    UNION ALL
    SELECT symbol, rising, n, k, step + 1, CASE WHEN lo THEN (l1 + l2) / 2 ELSE l1 END, CASE WHEN lo THEN l2 ELSE (l1 + l2) / 2 END, CASE WHEN hi THEN (h1 + h2) / 2 ELSE h1 END, CASE WHEN hi THEN h2 ELSE (h1 + h2) / 2 END
    FROM (SELECT *, {tail_sql('k', '((l1 + l2) / 2)')} < 0.025 AS lo, 1 - {tail_sql('k + 1', '((h1 + h2) / 2)')} > 0.025 AS hi FROM walk WHERE step < 40)
  ), p AS (SELECT *, {tail_sql('k', '0.5::DOUBLE')} AS up, 1 - {tail_sql('k + 1', '0.5::DOUBLE')} AS down FROM walk WHERE step = 40)
  SELECT symbol, rising, n, k AS hits, {fx('least(up, 1)')} AS p_upper, {fx('least(1, 2 * least(up, down))')} AS p_value, {fx('CASE WHEN k = 0 THEN 0 ELSE l1 END')} AS low, {fx('CASE WHEN k = n THEN 1 ELSE h1 END')} AS high FROM p""")
def hit_rates(spark, sf_dir):
    """Whether returns after a rise and after a fall are positive more or less often than a coin: exact tails and intervals."""
    df = scored_input(spark, sf_dir, ["mom_5d"]).filter("mom_5d IS NOT NULL AND forward_return_5d IS NOT NULL").groupBy("symbol", (F.col("mom_5d") > 0).alias("rising"))
    df = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("forward_return_5d") > 0).alias("hits")).withColumn("t", binomial.hit_rate_test("hits", "n"))
    return df.select("symbol", "rising", "n", "hits", *[fixed(F.col("t")[c]).alias(c) for c in ("p_upper", "p_value", "low", "high")])


@query("v20_multiple_testing", f"WITH {IC}, t AS (SELECT {KEY}, rank_ic * sqrt((n_obs - 2) / (1 - rank_ic * rank_ic)) AS t FROM ic WHERE rank_ic IS NOT NULL), k AS (SELECT {KEY}, 1 / (1 + 0.2316419::DOUBLE * abs(t)) AS k, t FROM t), p AS (SELECT {KEY}, 2 * exp(-t * t / 2) / 2.5066282746310002::DOUBLE * (k * (0.319381530::DOUBLE + k * (-0.356563782::DOUBLE + k * (1.781477937::DOUBLE + k * (-1.821255978::DOUBLE + k * 1.330274429::DOUBLE))))) AS p FROM k), o AS (SELECT *, row_number() OVER (ORDER BY p, symbol, feature, label) AS r, count(*) OVER () AS m FROM p), h AS (SELECT *, p <= 0.05 / (m - r + 1) AS ok, (SELECT sum(1.0 / j) FROM range(1, CAST(m AS BIGINT) + 1) q(j)) AS hm FROM o), b AS (SELECT max(r) FILTER (p <= r * 0.05 / (m * hm)) AS last FROM h) SELECT {KEY}, {fx('p')} AS p_value, p * m <= 0.05 AS bonferroni, bool_and(ok) OVER (ORDER BY r) AS holm, r <= coalesce((SELECT last FROM b), 0) AS bhy FROM h")
def testing(spark, sf_dir):
    ic = scoring.rank_ic(scoring.pairs(scored_input(spark, sf_dir), FEATURES, LABELS)).filter("rank_ic IS NOT NULL")
    t = ic.select("symbol", "feature", "label", validation.normal_p_value(F.col("ic_t_stat")).alias("p_value"))
    return validation.multiple_testing(t).withColumn("p_value", fixed("p_value"))


@query("v21_rejected_log", f"WITH {IC}, s AS (SELECT feature, label, avg(rank_ic) AS v, count(*) AS n FROM ic GROUP BY feature, label), d AS (SELECT feature, label, min(date) AS first_date, max(date) AS last_date FROM pairs GROUP BY feature, label) SELECT feature AS pattern, label, first_date, last_date, n AS universe, {fx('v')} AS result, CASE WHEN v <= 0 THEN 'wrong sign' ELSE 'mean IC below 0.02' END AS reason FROM s JOIN d USING (feature, label) WHERE v < 0.02")
def rejected(spark, sf_dir):
    """Patterns that were to go up with the label and don't."""
    p = scoring.pairs(scored_input(spark, sf_dir), FEATURES, LABELS)
    dates = p.groupBy("feature", "label").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    g = scoring.rank_ic(p).groupBy("feature", "label").agg(F.avg("rank_ic").alias("v"), F.count(F.lit(1)).alias("universe")).filter("v < 0.02").join(dates, ["feature", "label"])
    return g.select(F.col("feature").alias("pattern"), "label", "first_date", "last_date", "universe", fixed("v").alias("result"), F.when(F.col("v") <= 0, "wrong sign").otherwise("mean IC below 0.02").alias("reason"))


CUM = []
_t, _s = 0.36787944117144233, 0.0
for _k in range(8):
    _s += _t
    CUM.append(_s)
    _t /= _k + 1


@query("v22_bootstrap_interval", f"WITH {BARS}, d AS (SELECT symbol, perm, returns, {DRAW('boot', 'perm', 'symbol', 'date')} / {float(16**13)!r}::DOUBLE AS u FROM panel, range(1, 201) p(perm)), w AS (SELECT *, {' + '.join(f'(u >= {c!r}::DOUBLE)::INT' for c in CUM)} AS w FROM d), m AS (SELECT symbol, perm, sum(w * returns) / sum(w) AS m FROM w GROUP BY symbol, perm) SELECT symbol, count(m) AS rounds, {fx('quantile_cont(m, 0.025)')} AS low, {fx('quantile_cont(m, 0.975)')} AS high FROM m GROUP BY symbol")
def bootstrap(spark, sf_dir):
    df = validation.bootstrap_interval(sample(spark, sf_dir), "returns", ["symbol", "date"])
    return df.withColumns({"low": fixed("low"), "high": fixed("high")})


@query("v23_walk_forward", f"WITH {BARS}, z AS (SELECT CAST(date_trunc('month', min(date)) AS DATE) AS a, CAST(date_trunc('month', max(date)) + INTERVAL 1 MONTH AS DATE) AS z FROM panel), e AS (SELECT CAST(e AS INT) AS epoch, a + to_months(CAST(6 * e AS INT)) AS a FROM z, range(1000) t(e) WHERE e < (datediff('month', a, z) - 30) // 6), s AS (SELECT epoch, 'train' AS role, a AS f, a + INTERVAL 24 MONTH AS z FROM e UNION ALL SELECT epoch, 'validation', a + INTERVAL 24 MONTH, a + INTERVAL 30 MONTH FROM e UNION ALL SELECT epoch, 'test', a + INTERVAL 30 MONTH, a + INTERVAL 36 MONTH FROM e), g AS (SELECT epoch, role, count(*) AS n, avg(returns) AS m, stddev_pop(returns) AS d, avg((returns > 0)::INT) AS h, min(date) AS first_date, max(date) AS last_date FROM panel JOIN s ON date >= f AND date < z GROUP BY epoch, role) SELECT epoch, role, n, {fx('m')} AS mean_return, {fx('d')} AS std_return, {fx('h')} AS hit_rate, first_date, last_date, count(*) FILTER (role <> 'train' AND m > 0) OVER (PARTITION BY epoch) = 2 AS promoted FROM g")
def walk(spark, sf_dir):
    p = sample(spark, sf_dir)
    epochs = validation.walk_forward(p.agg(F.min("date").alias("first"), F.max("date").alias("last")))
    return validation.epoch_review(validation.in_epochs(p, epochs)).withColumns({c: fixed(c) for c in ("mean_return", "std_return", "hit_rate")})


@query("v6_multi_horizon_cv", f"WITH {BARS}, n AS (SELECT min(k) AS n FROM (SELECT count(*) AS k FROM panel GROUP BY symbol)), s AS (SELECT h.h AS horizon, CAST(s AS INT) AS split, n - (5 - s) * (n // 6) AS test, n // 6 AS size FROM n, range(5) t(s), (VALUES (1), (3), (5), (10), (20)) h(h)) SELECT split, CAST(test - 2 * horizon AS INT) AS train_last, CAST(test + 1 AS INT) AS test_first, test - 2 * horizon AS n_train, size AS n_test, test - 2 * horizon + horizon >= test + 1 AS overlaps, test - 2 * horizon < test + 1 AS chronological, horizon FROM s WHERE test - 2 * horizon >= 20")
def multi_horizon(spark, sf_dir):
    n = sample(spark, sf_dir).groupBy("symbol").count().agg(F.min("count")).first()[0] or 0
    return validation.multi_horizon_splits(spark, n, (1, 3, 5, 10, 20))


@query("v11_decile_polarity", f"WITH {LONG}, d AS (SELECT *, ntile(10) OVER (PARTITION BY feature, label ORDER BY x, symbol, date) AS decile FROM pairs), g AS (SELECT feature, label, avg(x) FILTER (decile = 1) AS a, avg(x) FILTER (decile = 10) AS b, avg(y) FILTER (decile = 1) AS c, avg(y) FILTER (decile = 10) AS d FROM d GROUP BY feature, label) SELECT feature, label, {fx('a')} AS d1_score, {fx('b')} AS d10_score, {fx('c')} AS d1_label, {fx('d')} AS d10_label, sign(d - c)::DOUBLE AS polarity FROM g")
def polarities(spark, sf_dir):
    df = validation.polarity(scoring.pairs(scored_input(spark, sf_dir), FEATURES, LABELS))
    return df.withColumns({c: fixed(c) for c in ("d1_score", "d10_score", "d1_label", "d10_label")})
