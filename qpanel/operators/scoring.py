"""Feature x label scores (A1-A18): statistics, rank IC, mutual information, decile spreads, stability, status, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qpanel.functions.windows import safe_corr
from qpanel.sources.tables import settled

from .labels import long_form
from .quantiles import quantiles, tiles

LEAST_IC, LEAST_SPREAD, LEAST_STABILITY, SEGMENTS, LEAST_SEGMENT = 50, 100, 500, 3, 20
BINS = 20
PAIR = ("symbol", "feature", "label")


def statistics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """A1. Count, missing, mean and deviation of each (symbol, feature): partial aggregates, one small row per key shuffled."""
    return long_form(df, features, "feature", "value").groupBy("symbol", "feature").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("value").isNull()).alias("n_nan"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def clean(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def pairs(df: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """J11. Rows (symbol, date, feature, label, x, y) with both values present, by one explode of the row's own columns: no join."""
    fx = F.array(*[F.struct(F.lit(f).alias("feature"), clean(F.col(f).cast("double")).alias("x")) for f in features])
    ly = F.array(*[F.struct(F.lit(n).alias("label"), clean(F.col(n).cast("double")).alias("y")) for n in labels])
    out = df.select("symbol", "date", F.explode(fx).alias("_f"), ly.alias("_ly")).filter("_f.x IS NOT NULL").select("symbol", "date", "_f.*", F.explode("_ly").alias("_l"))
    return out.filter("_l.y IS NOT NULL").select("symbol", "date", "feature", "x", "_l.*")


def rank_of(x: str, by: Sequence[str]) -> Column:
    """Average rank: ties share the mean of their places."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0


def rank_ic(p: DataFrame, by: Sequence[str] = PAIR, least: int = LEAST_IC) -> DataFrame:
    """A3, A4. Spearman correlation of each pair with its t-statistic; NULL below least rows."""
    ranked = p.withColumns({"rx": rank_of("x", by), "ry": rank_of("y", by)})
    df = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_obs"), safe_corr(F.col("rx"), F.col("ry")).alias("_ic"))
    df = df.withColumn("rank_ic", F.when(F.col("n_obs") >= least, F.col("_ic"))).drop("_ic")
    t = F.when(F.abs("rank_ic") >= 1, 0.0).otherwise(F.col("rank_ic") * F.sqrt((F.col("n_obs") - 2) / (1 - F.col("rank_ic") * F.col("rank_ic"))))
    return df.withColumn("ic_t_stat", t)


def edges_of(x: str, bins: int) -> Column:
    return F.percentile(x, F.array(*[F.lit(k / bins) for k in range(bins + 1)]))


def place(x: Column, edges: Column) -> Column:
    """How many of the distinct edges are at or below x."""
    return F.size(F.filter(F.array_distinct(edges), lambda e: e <= x))


def mutual_information(p: DataFrame, by: Sequence[str] = PAIR, bins: int = BINS, least: int = LEAST_IC) -> DataFrame:
    """A5. Mutual information of percentile bins, in nats; 0 below least rows."""
    edges = p.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), edges_of("x", bins).alias("_ex"), edges_of("y", bins).alias("_ey"))
    binned = p.join(edges, list(by)).select(*by, "_n", place(F.col("x"), F.col("_ex")).alias("bx"), place(F.col("y"), F.col("_ey")).alias("by_"))
    joint = binned.groupBy(*by, "_n", "bx", "by_").agg(F.count(F.lit(1)).alias("c"))
    cx, cy = (F.sum("c").over(Window.partitionBy(*by, b)) for b in ("bx", "by_"))
    n = F.col("_n").cast("double")
    term = F.col("c") / n * F.ln(F.col("c") * n / (cx * cy))
    df = joint.withColumn("_t", term).groupBy(*by).agg(F.max("_n").alias("n_obs"), F.sum("_t").alias("mi"))
    return df.withColumn("mutual_information", F.when(F.col("n_obs") >= least, F.greatest(F.col("mi"), F.lit(0.0))).otherwise(0.0)).drop("mi")


def decile_spread(p: DataFrame, by: Sequence[str] = PAIR, least: int = LEAST_SPREAD) -> DataFrame:
    """A6. Mean label above the highest and below the lowest decile edge, and their difference; values tied at an edge share a bucket."""
    edges = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n_obs"), F.percentile("x", F.array(F.lit(0.1), F.lit(0.9))).alias("_e"))
    df = p.join(edges, list(by)).groupBy(*by, "n_obs").agg(F.avg(F.when(F.col("x") >= F.col("_e")[1], F.col("y"))).alias("top"), F.avg(F.when(F.col("x") <= F.col("_e")[0], F.col("y"))).alias("bottom"))
    enough = F.col("n_obs") >= least
    return df.select(*by, "n_obs", F.when(enough, F.col("top")).alias("top_decile_return"), F.when(enough, F.col("bottom")).alias("bottom_decile_return"), F.when(enough, F.col("top") - F.col("bottom")).otherwise(0.0).alias("decile_spread"))


def decile_table(p: DataFrame, by: Sequence[str] = ("feature", "label")) -> DataFrame:
    """A7. Ten groups of equal size: count, mean, median and hit rate of the label, and whether means rise or fall throughout.

    A pair may hold as many rows as the panel, so it is ranked in parts, and no part is gathered.
    """
    rows = settled(tiles(settled(p), by, "x", ("symbol", "date"), 10, "decile"))
    t = rows.groupBy(*by, "decile").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.avg((F.col("y") > 0).cast("double")).alias("hit_rate"))
    t = t.join(quantiles(rows, [*by, "decile"], "y", [0.5]), [*by, "decile"]).withColumn("median", F.get("q", F.lit(0))).drop("q")
    d = Window.partitionBy(*by)
    step = F.signum(F.col("mean") - F.lag("mean").over(d.orderBy("decile")))
    t = t.withColumn("_step", step)
    return t.withColumn("monotonic", F.abs(F.sum("_step").over(d)) == 9).withColumn("d10_minus_d1", F.max_by("mean", "decile").over(d) - F.min_by("mean", "decile").over(d)).drop("_step")


def segment(n: int = SEGMENTS, by: Sequence[str] = PAIR, order: str = "date") -> Column:
    """Equal parts of a pair's rows in time order; what is over goes to the last."""
    w = Window.partitionBy(*by)
    size = F.floor(F.count(F.lit(1)).over(w) / n)
    return F.least(F.floor((F.row_number().over(w.orderBy(order)) - 1) / F.greatest(size, F.lit(1))), F.lit(n - 1)).cast("int")


def ic_stability(p: DataFrame, by: Sequence[str] = PAIR, split: str = "thirds", least: int = LEAST_STABILITY) -> DataFrame:
    """A9, A10. IC in thirds of the rows, or in years: its list, its deviation, and whether that passes 0.05."""
    part = segment(by=by) if split == "thirds" else F.year("date")
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    df = p.withColumns({"segment": part, "_total": total}).filter(F.col("_total") >= least)
    ic = rank_ic(df, [*by, "segment"], LEAST_SEGMENT).filter("rank_ic IS NOT NULL")
    out = ic.groupBy(*by).agg(F.count(F.lit(1)).alias("n_segments"), F.stddev_pop("rank_ic").alias("ic_std"), F.min("rank_ic").alias("ic_min"), F.max("rank_ic").alias("ic_max"))
    return out.withColumn("unstable", (F.col("n_segments") >= 2) & (F.col("ic_std") > 0.05))


def status(missing: Column, ic: Column, mi: Column, spread: Column) -> Column:
    """A11."""
    i, m, s = F.abs(F.coalesce(ic, F.lit(0.0))), F.coalesce(mi, F.lit(0.0)), F.abs(F.coalesce(spread, F.lit(0.0)))
    return F.when(missing > 0.5, "BLOCKED").when((i < 0.01) & (m < 0.001) & (s < 0.001), "DEAD").when(i < 0.02, "WEAK").otherwise("CANDIDATE")


def extended_status(ic: Column, unstable: Column, spread: Column, cost: Column, role: Column) -> Column:
    """A12. From dead to candidate of a kind."""
    return (
        F.when(F.abs(F.coalesce(ic, F.lit(0.0))) < 0.01, "DEAD")
        .when(F.coalesce(unstable, F.lit(False)), "UNSTABLE_SIGNAL")
        .when(F.abs(spread) <= cost, "COST_FAILED")
        .when(F.abs(ic) < 0.02, "RAW_SIGNAL")
        .otherwise(F.concat(F.upper(role), F.lit("_CANDIDATE")))
    )


def stability_score(df: DataFrame, features: Sequence[str], least: int = 60) -> DataFrame:
    """A13. 1 / (1 + variation of segment means + variation of segment deviations); 0 below least rows."""
    x = long_form(df, features, "feature", "value").filter("value IS NOT NULL")
    by = ("symbol", "feature")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    seg = x.withColumns({"segment": segment(by=by), "_n": n}).groupBy(*by, "_n", "segment").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    cv = lambda c: F.coalesce(F.try_divide(F.stddev_pop(c), F.abs(F.avg(c))), F.lit(0.0))
    out = seg.groupBy(*by).agg(F.max("_n").alias("n_obs"), (1.0 / (1.0 + cv("m") + cv("s"))).alias("_s"))
    return out.withColumn("stability", F.when(F.col("n_obs") >= least, F.col("_s")).otherwise(0.0)).drop("_s")


def score(df: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """The whole score row of each (symbol, feature, label): A3-A6, A8, A9, A11."""
    p = pairs(df, features, labels)
    total = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_total"))
    missing = statistics(df, features).select("symbol", "feature", (F.col("n_nan") / F.col("n_values")).alias("missing_rate"))
    out = rank_ic(p).join(mutual_information(p).drop("n_obs"), list(PAIR), "left").join(decile_spread(p).drop("n_obs"), list(PAIR), "left").join(ic_stability(p), list(PAIR), "left")
    out = out.join(total, "symbol").join(missing, ["symbol", "feature"])
    return out.withColumn("status", status(F.col("missing_rate"), F.col("rank_ic"), F.col("mutual_information"), F.col("decile_spread")))


SCORES = "symbol string, feature string, label string, n_obs long, n_total long, missing_rate double, inf_rate double, rank_ic double, ic_t_stat double, mutual_information double, top_decile_return double, bottom_decile_return double, decile_spread double, n_segments long, ic_std double, ic_min double, ic_max double, unstable boolean"


def all_scores(df: DataFrame, features: Sequence[str], labels: Sequence[str], cost: float = 0.001, role: str = "alpha") -> DataFrame:
    """The score row of each (symbol, feature, label), as score() states it, for all features and labels at once.

    A symbol's bars come to one task as one table, in which columns are ranked and binned
    once for all pairs that share their rows; exploding pairs would multiply every bar by
    features x labels. A symbol has one bar a date, so no group grows with the symbols.
    Infinite values are missing to the scores and counted in inf_rate.
    """
    features, labels = list(features), list(labels)

    def scored(frame):
        import numpy as np
        import pandas as pd

        from qpanel.functions.pairs import symbol_scores

        frame = frame.sort_values("date")
        x, y = frame[features].to_numpy(dtype=float), frame[labels].to_numpy(dtype=float)
        missing, infinite = np.isnan(x).mean(axis=0), np.isinf(x).mean(axis=0)
        rows = []
        for f, label, n, ic, mi, top, bottom, spread, k, std, low, high in symbol_scores(x, y):
            t = 0.0 if abs(ic) >= 1 else ic * np.sqrt((n - 2) / (1 - ic * ic))
            rows.append((frame["symbol"].iloc[0], features[f], labels[label], n, len(frame), missing[f], infinite[f], ic, t, mi, top, bottom, spread, k, std, low, high, bool(k >= 2 and std > 0.05)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCORES.split(", ")])

    cols = [F.col(c).cast("double").alias(c) for c in (*features, *labels)]
    out = df.select("symbol", "date", *cols).groupBy("symbol").applyInPandas(scored, SCORES)
    out = out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("rank_ic", "ic_t_stat", "top_decile_return", "bottom_decile_return", "ic_std", "ic_min", "ic_max")})
    out = out.withColumn("status", status(F.col("missing_rate"), F.col("rank_ic"), F.col("mutual_information"), F.col("decile_spread")))
    return out.withColumn("extended_status", extended_status(F.col("rank_ic"), F.col("unstable"), F.col("decile_spread"), F.lit(cost), F.lit(role)))


def feature_merits(scores: DataFrame) -> DataFrame:
    """A14, V4. Each feature over its symbols and labels: mean absolute IC, mutual information, missing rate, shares of dead and of unstable pairs."""
    return scores.groupBy("feature").agg(
        F.avg(F.abs("rank_ic")).alias("ic"), F.avg("mutual_information").alias("mi"), F.avg("missing_rate").alias("missing_rate"), F.avg((F.col("status") == "DEAD").cast("double")).alias("dead_share"), F.avg(F.col("unstable").cast("double")).alias("unstable_share"), F.count(F.lit(1)).alias("n_pairs")
    )


def validation_report(scores: DataFrame, clusters: DataFrame, lookahead_differ: int, k: int = 20) -> DataFrame:
    """A17. One row: counts, the k best features, dead and unstable ones, clusters, the look-ahead status and an overall one. Lists hold names of features only."""
    m = feature_merits(scores)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("ic"), "feature"))
    named = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("feature"))))
    lists = m.withColumn("_k", rank).agg(named(F.col("_k") <= k).alias("top"), named(F.col("dead_share") == 1).alias("dead"), named(F.col("unstable_share") > 0.5).alias("unstable"), F.count(F.lit(1)).alias("n_features"))
    counts = scores.agg(F.count(F.lit(1)).alias("n_pairs"), *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("BLOCKED", "DEAD", "WEAK", "CANDIDATE")])
    groups = clusters.agg(F.countDistinct("cluster").alias("n_clusters"), F.count(F.lit(1)).alias("n_redundant"))
    row = counts.join(F.broadcast(lists)).join(F.broadcast(groups))
    row = row.withColumn("lookahead_status", F.lit("PASS" if lookahead_differ == 0 else "FAIL"))
    return row.withColumn("overall", F.when(F.col("lookahead_status") == "FAIL", "BLOCKED").when(F.col("n_candidate") == 0, "NO_CANDIDATES").otherwise("OK"))


def composite_rank(mi: DataFrame, stability: DataFrame, k: int = 20) -> DataFrame:
    """A14. The k features with the largest 0.7 MI + 0.3 stability, averaged over symbols."""
    df = mi.join(stability.select("symbol", "feature", "stability"), ["symbol", "feature"])
    df = df.filter(F.col("n_obs") >= 100).groupBy("feature").agg(F.avg("mutual_information").alias("mi"), F.avg("stability").alias("stability"))
    return df.withColumn("score", 0.7 * F.col("mi") + 0.3 * F.col("stability")).orderBy(F.desc("score"), "feature").limit(k)


def top_candidates(scores: DataFrame, k: int = 20) -> DataFrame:
    """A15."""
    return scores.filter(F.col("status").isin("CANDIDATE", "WEAK")).orderBy(F.abs("rank_ic").desc_nulls_last(), "feature", "label", "symbol").limit(k)


def run_summary(scores: DataFrame) -> DataFrame:
    """A16."""
    return scores.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("feature").alias("n_features"), F.countDistinct("label").alias("n_labels"), F.count_if(F.col("status") == "DEAD").alias("n_dead"), F.count_if(F.col("status") == "BLOCKED").alias("n_blocked"), F.sort_array(F.collect_set("status")).alias("statuses"))


def set_composites(df: DataFrame, sets: dict[str, Sequence[str]], signs: dict[str, int] | None = None) -> DataFrame:
    """A18. For each named set the mean of its features' percentile ranks and of their z-scores within a symbol, features with a negative sign turned over."""
    signs = signs or {}
    names = sorted({f for fs in sets.values() for f in fs})
    turned = df.select("symbol", "date", *[(F.col(f) * signs.get(f, 1)).alias(f) for f in names])
    z = Window.partitionBy("symbol")
    turned = turned.withColumns({f"_z_{f}": F.try_divide(F.col(f) - F.avg(f).over(z), F.stddev_pop(f).over(z)) for f in names})
    # missing values form a part of their own, out of the ranks
    turned = turned.withColumns({f"_r_{f}": F.when(F.col(f).isNotNull(), F.percent_rank().over(Window.partitionBy("symbol", F.col(f).isNotNull()).orderBy(f))) for f in names})
    mean = lambda cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)
    return turned.select("symbol", "date", *[mean([f"_r_{f}" for f in fs]).alias(f"{n}_rank_average") for n, fs in sets.items()], *[mean([f"_z_{f}" for f in fs]).alias(f"{n}_z_average") for n, fs in sets.items()])
