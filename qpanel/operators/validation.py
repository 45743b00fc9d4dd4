"""Audits and resampling (V1-V23): leakage, redundancy, purged splits, baselines, subset and ledger checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qpanel.sources.tables import settled

from .labels import long_form
from .quantiles import tiles

#: Names that speak of the future. Fixed values.
FUTURE_WORDS = ("forward", "future", "next", "lead", "target", "label")
HORIZON = 20


def warmup_audit(df: DataFrame, registry: DataFrame, features: Sequence[str], most: float = 0.05) -> DataFrame:
    """V2. Missing values before and after each feature's warm-up."""
    x = long_form(df, features, "feature", "value", ids=("symbol", "date", "i")).join(F.broadcast(registry.select("feature", "lookback")), "feature")
    after = F.col("i") >= F.col("lookback")
    out = x.groupBy("feature", "lookback").agg(F.count_if(~after & F.col("value").isNull()).alias("expected_nan"), F.count_if(after & F.col("value").isNull()).alias("unexpected_nan"), F.count_if(after).alias("n_after"))
    out = out.withColumn("unexpected_rate", F.coalesce(F.try_divide("unexpected_nan", "n_after"), F.lit(0.0)))
    return out.withColumn("verdict", F.when(F.col("unexpected_rate") <= most, "WARMUP_ONLY").otherwise("UNEXPECTED_NAN"))


def correlation_pairs(df: DataFrame, features: Sequence[str], least: int = 20) -> DataFrame:
    """V3, J10. Pearson correlation of all feature pairs over rows where both are present, by one aggregate: no self-join.

    Partial sums are combined within map tasks; the result has pairs x 1 rows.
    """
    names = list(features)
    aggregates = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = F.col(a), F.col(b)
            both = x.isNotNull() & y.isNotNull()
            px, py = F.when(both, x), F.when(both, y)
            aggregates.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("n"), F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py)).alias("r")))
    out = df.agg(F.array(*aggregates).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return out.withColumn("r", F.when(F.col("n") >= least, F.coalesce("r", F.lit(0.0))).otherwise(0.0))


def wide_correlations(df: DataFrame, features: Sequence[str], least: int = 20) -> DataFrame:
    """V3, J10. correlation_pairs() of very many features: (a, b, n, r), and each feature with itself, whose variance is in var.

    Tasks make products of their rows' matrices, batch by batch; what is shuffled and
    added up has features x features rows from each task. Values are taken from the
    features' means first, so that large ones keep their digits.
    """
    import numpy as np
    import pyarrow as pa

    names = list(features)
    values = [F.when(F.abs(F.col(n).cast("double")) < float("inf"), F.col(n).cast("double")) for n in names]
    means = df.select(*[F.avg(v).alias(n) for v, n in zip(values, names)]).first()
    shift = np.array([means[n] or 0.0 for n in names])
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), *[(c, pa.float64()) for c in ("n", "x", "y", "xx", "yy", "xy")]])

    def products(batches):
        total = None
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) - shift
            ok = np.isfinite(x)
            x, m = np.where(ok, x, 0.0), ok.astype(float)
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(names))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(t[i, j]) for t in total]], schema=schema)

    sums = df.select(*[v.alias(n) for v, n in zip(values, names)]).mapInArrow(products, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    sums = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    vx, vy = F.col("xx") / n - x * x / (n * n), F.col("yy") / n - y * y / (n * n)
    r = F.try_divide(F.col("xy") / n - x * y / (n * n), F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))
    named = F.array(*map(F.lit, names))
    return sums.filter("n > 0").select(F.get(named, F.col("i")).alias("a"), F.get(named, F.col("j")).alias("b"), n.cast("long").alias("n"), F.when(n >= least, F.coalesce(r, F.lit(0.0))).otherwise(0.0).alias("r"), F.when(F.col("i") == F.col("j"), vx).alias("var"))


def cluster_rows(correlations: DataFrame, order: Sequence[str], threshold: float = 0.90) -> DataFrame:
    """V3. The clusters of redundancy_clusters() as rows (cluster, feature, theme, by_variance), from the result of wide_correlations()."""
    spark = correlations.sparkSession
    variances = {r["a"]: r["var"] for r in correlations.filter("a = b").select("a", "var").collect()}
    found = redundancy_clusters(correlations.filter("a <> b"), variances, order, threshold)
    rows = [(c["seed"], f, c["theme"], c["representative"]) for c in found for f in c["members"]]
    return spark.createDataFrame(rows, "cluster string, feature string, theme string, by_variance string")


def redundancy_clusters(correlations: DataFrame, variances: dict[str, float], order: Sequence[str], threshold: float = 0.90) -> list[dict]:
    """V3, T22. Greedy clusters in a fixed order; members compare with the seed only.

    The edge list has features x features rows at most, whatever the data's size, so the
    greedy step, which is sequential, runs on the driver.
    """
    strong = {(r["a"], r["b"]) for r in correlations.filter(F.abs("r") >= threshold).select("a", "b").collect()}
    left, found = list(order), []
    while left:
        seed = left.pop(0)
        members = [seed, *[f for f in left if (seed, f) in strong or (f, seed) in strong]]
        left = [f for f in left if f not in members]
        if len(members) > 1:
            found.append({"seed": seed, "members": members, "representative": max(members, key=lambda f: (variances.get(f) or 0.0, f)), "theme": theme(members)})
    return found


def theme(names: Sequence[str]) -> str:
    """P14. The common start of the names, up to an underscore, or general."""
    parts = [n.split("_") for n in names]
    same = []
    for group in zip(*parts):
        if len(set(group)) > 1:
            break
        same.append(group[0])
    return "_".join(same) or "general"


def representative(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """V4. The member of each cluster with the best IC, stability and completeness: scores(feature, ic, stability, missing_rate), clusters(cluster, feature)."""
    merit = F.abs("ic") + 0.25 * F.col("stability") - 0.5 * F.col("missing_rate")
    return clusters.join(scores, "feature").groupBy("cluster").agg(F.max_by("feature", F.struct(merit, "feature")).alias("representative"))


def purged_splits(spark: SparkSession, n: int, k: int = 5, horizon: int = HORIZON, purge: int | None = None, embargo: int | None = None) -> DataFrame:
    """V5. Bounds of k walk-forward splits of n bars: (split, role, first, last), 1-based; splits too small are left out. Purge and embargo are the horizon unless given."""
    purge, embargo = horizon if purge is None else purge, horizon if embargo is None else embargo
    size = n // (k + 1)
    if size < 5:
        raise ValueError(f"{n} bars are too few for {k} splits")
    rows = []
    for s in range(k):
        test = n - (k - s) * size
        train = test - purge - embargo
        if train >= 20:
            rows += [(s, "train", 1, train), (s, "test", test + 1, test + size)]
    return spark.createDataFrame(rows, "split int, role string, first int, last int")


def assign_splits(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars with their splits and roles: a range join with a handful of bounds."""
    return panel.join(F.broadcast(splits), F.col("i").between(F.col("first"), F.col("last"))).drop("first", "last")


def verify_splits(splits: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """V6. Per split: sizes, whether a training label reaches into the test block, and whether time runs forward."""
    at = lambda role, c, f: f(F.when(F.col("role") == role, F.col(c)))
    df = splits.groupBy("split").agg(at("train", "last", F.max).alias("train_last"), at("test", "first", F.min).alias("test_first"), F.sum(F.when(F.col("role") == "train", F.col("last") - F.col("first") + 1)).alias("n_train"), F.sum(F.when(F.col("role") == "test", F.col("last") - F.col("first") + 1)).alias("n_test"))
    return df.withColumn("overlaps", F.col("train_last") + horizon >= F.col("test_first")).withColumn("chronological", F.col("train_last") < F.col("test_first"))


def multi_horizon_splits(spark: SparkSession, n: int, horizons: Sequence[int], k: int = 5) -> DataFrame:
    """V6b. The splits of each horizon, verified: one row for each horizon and split."""
    out = None
    for h in horizons:
        part = verify_splits(purged_splits(spark, n, k, h), h).withColumn("horizon", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return out


def lookahead_test(full: DataFrame, truncated: DataFrame, features: Sequence[str]) -> DataFrame:
    """V7. Features of the truncated history that differ from those of the whole: none may.

    Whole rows meet once by (symbol, date), and one aggregate counts all features' differences.
    """
    keys, names = ["symbol", "date"], list(features)
    a = full.select(*keys, *[F.col(f).alias(f"full_{k}") for k, f in enumerate(names)])
    both = truncated.select(*keys, *[F.col(f).alias(f"cut_{k}") for k, f in enumerate(names)]).join(a, keys, "left")

    def differs(k: int) -> Column:
        x, y = F.col(f"full_{k}").cast("double"), F.col(f"cut_{k}").cast("double")
        return ~x.eqNullSafe(y) & ~F.coalesce(F.abs(x - y) <= 1e-9 * F.greatest(F.abs(x), F.lit(1.0)), F.lit(False))

    counts = both.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(differs(k)).alias(f"d_{k}") for k in range(len(names))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("n"), F.col(f"d_{k}").alias("n_differ")) for k, f in enumerate(names)])
    return counts.select(F.explode(rows).alias("r")).select("r.*").withColumn("passed", F.col("n_differ") == 0)


def draw(seed: str, *cols: str | Column) -> Column:
    """A number in [0, 1) from a digest: the same whatever the partitioning, and in any engine."""
    text = F.concat_ws(":", F.lit(seed), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def dealt_out(df: DataFrame, *key: str) -> DataFrame:
    """df on as many tasks as the session's shuffles have, before each row is multiplied: small tables are otherwise merged into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def null_baselines(df: DataFrame, feature: str, labels: Sequence[str], perms: int = 20, seed: str = "null") -> DataFrame:
    """V8. What rank correlations are left without any relation, for each label: with labels dealt out anew within each symbol, and with a random feature.

    Mean and deviation of their absolute values over permutations and symbols, and their 95th percentile.
    Ranks are settled once; only one side of the join has a row for each permutation, and
    none is broadcast, as ranks take little room in files and far more in memory.
    """
    x = df.select("symbol", "date", F.col(feature).alias("x"), F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("y")) for n in labels])).alias("l")).select("symbol", "date", "x", "l.*").filter("x IS NOT NULL AND y IS NOT NULL")
    by = Window.partitionBy("symbol", "label")
    x = settled(x.select("symbol", "date", "label", F.rank().over(by.orderBy("x")).alias("rx"), F.rank().over(by.orderBy("y")).alias("ry"), F.row_number().over(by.orderBy("date")).alias("place")))
    many = dealt_out(x.drop("rx", "place"), "symbol", "label", "date").withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    # a random order of a permutation deals out labels, and is itself a feature's ranks
    many = many.withColumn("turn", F.row_number().over(Window.partitionBy("symbol", "label", "perm").orderBy(draw(seed, "perm", "symbol", "date"), "date")))
    key = ["symbol", "label", "perm"]
    places = x.select("symbol", "label", F.col("place").alias("turn"), "rx").hint("merge")
    shuffled = many.join(places, ["symbol", "label", "turn"]).groupBy(*key).agg(F.corr("rx", "ry").alias("ic")).withColumn("baseline", F.lit("shuffled_label"))
    random_ = many.groupBy(*key).agg(F.corr(F.col("turn").cast("double"), F.col("ry")).alias("ic")).withColumn("baseline", F.lit("random_feature"))
    a = F.abs("ic")
    return shuffled.unionByName(random_).groupBy("label", "baseline").agg(F.count("ic").alias("n"), F.avg(a).alias("mean_abs_ic"), F.stddev_pop(a).alias("std_abs_ic"), F.percentile(a, 0.95).alias("p95_abs_ic"))


def random_pruning(pool: DataFrame, size: Column, perms: int = 250, seed: str = "prune", group: Sequence[str] = ("strategy",), value: str = "ret", key: Sequence[str] = ("symbol", "date"), first: int = 1, buckets: int = 256) -> DataFrame:
    """V9. Means of random draws without replacement of a given size from a strategy's own pool, for permutations first to perms.

    The smallest hashes of a permutation are its draw. Hashes fall into buckets, whose
    counts and sums are combined within map tasks; only the bucket in which a draw ends
    is sorted, a share of 1 / buckets of the rows.
    """
    rows = dealt_out(pool.select(*group, *key, F.col(value).alias("_v"), size.alias("_k")), *key)
    many = rows.select("*", F.explode(F.sequence(F.lit(first), F.lit(perms))).alias("perm")).withColumn("_u", draw(seed, "perm", *key))
    many = many.withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    by = [*group, "perm"]
    sums = many.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"), F.max("_k").alias("_k"))
    sums = sums.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")))
    whole = sums.filter(F.col("_upto") <= F.col("_k")).select(*by, "_n", "_s")
    last = sums.filter((F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k"))).select(*by, "_b", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_need"))
    # a row for each strategy and permutation
    inside = many.join(F.broadcast(last), [*by, "_b"]).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_u", *key))).filter(F.col("_r") <= F.col("_need"))
    found = whole.unionByName(inside.select(*by, F.lit(1).cast("long").alias("_n"), F.col("_v").alias("_s")))
    return found.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("draw_mean"), F.sum("_n").alias("n_drawn"))


def two_stage_pruning(pool: DataFrame, size: Column, actual: DataFrame, perms: tuple[int, int] = (250, 750), seed: str = "prune", group: Sequence[str] = ("strategy",)) -> DataFrame:
    """V9. A verdict from the first permutations; strategies that don't fail there are judged by all of them."""
    draws = settled(random_pruning(pool, size, perms[0], seed, group))
    stage = pruning_verdict(draws, actual, group)
    on = list(group)
    again = pool.join(F.broadcast(stage.filter("verdict <> 'FAILS'").select(*on)), on, "left_semi")
    both = settled(draws.unionByName(random_pruning(again, size, perms[1], seed, group, first=perms[0] + 1)))
    final = pruning_verdict(both, actual, group).join(both.groupBy(*on).agg(F.count(F.lit(1)).alias("perms")), on)
    return final.join(stage.select(*on, F.col("verdict").alias("first_verdict")), on)


def pruning_verdict(draws: DataFrame, actual: DataFrame, group: Sequence[str] = ("strategy",)) -> DataFrame:
    """The filtered mean against the draws' 50th, 95th and 99th percentile. actual(group, filtered_mean)."""
    q = draws.groupBy(*group).agg(*[F.percentile("draw_mean", p / 100).alias(f"p{p}") for p in (50, 95, 99)])
    df = actual.join(q, list(group))
    return df.withColumn("verdict", F.when(F.col("filtered_mean") > F.col("p95"), "BEATS").when(F.col("filtered_mean") > F.col("p50"), "BORDERLINE").otherwise("FAILS"))


def subset_audit(base: DataFrame, filtered: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """V10, V13. Rows, repeats, and how many of the filtered rows are not in the base: a pure filter adds none."""
    b, f = base.select(*keys), filtered.select(*keys)
    both = b.distinct().withColumn("_b", F.lit(1)).join(f.groupBy(*keys).agg(F.count(F.lit(1)).alias("_f")), list(keys), "full_outer")
    df = both.agg(F.count("_b").alias("n_base"), F.count("_f").alias("n_filtered"), F.count_if(F.col("_b").isNull()).alias("n_new"), F.count_if(F.col("_f").isNull()).alias("n_removed"), F.coalesce(F.sum(F.col("_f") - 1), F.lit(0)).alias("n_repeated"))
    return df.withColumn("verdict", F.when(F.col("n_new") == 0, "PURE_FILTER").otherwise("NOT_A_SUBSET"))


def polarity(p: DataFrame, by: Sequence[str] = ("feature", "label")) -> DataFrame:
    """V11. Mean feature and label in the first and last tenth, and the sign of the relation."""
    t = tiles(settled(p), by, "x", ("symbol", "date"), 10, "d").filter("d IN (1, 10)")
    at = lambda d, c: F.avg(F.when(F.col("d") == d, F.col(c)))
    df = t.groupBy(*by).agg(at(1, "x").alias("d1_score"), at(10, "x").alias("d10_score"), at(1, "y").alias("d1_label"), at(10, "y").alias("d10_label"))
    return df.withColumn("polarity", F.signum(F.col("d10_label") - F.col("d1_label")))


def duplicate_results(results: DataFrame, metrics: Sequence[str], name: str = "strategy") -> DataFrame:
    """V12. Names whose metrics are all the same as another's: a row for each, with the group's first name and size. No group is gathered."""
    groups = results.groupBy(*metrics).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("same_as")).filter("n > 1")
    return results.join(groups, list(metrics)).select(*metrics, name, "same_as", "n")


def event_flags(panel: DataFrame) -> DataFrame:
    """V14. Proxies of events: gaps, volume spikes, extreme returns, wide ranges against their 20-bar means."""
    from qpanel.functions.windows import lag, mean0

    before = lag("close")
    tr = F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    df = panel.withColumns({"_gap": F.when(before > 0, F.col("open") / before - 1), "_tr": tr, "_v20": mean0("volume", 20)})
    df = df.withColumn("_tr20", mean0("_tr", 20))
    return df.withColumns(
        {
            "gap_down": F.coalesce(F.col("_gap") <= -0.05, F.lit(False)), "gap_up": F.coalesce(F.col("_gap") >= 0.05, F.lit(False)),
            "volume_spike": F.coalesce(F.col("volume") / F.col("_v20") >= 3, F.lit(False)), "extreme_return": F.abs("returns") >= 0.05,
            "wide_range": F.coalesce(F.col("_tr") / F.col("_tr20") >= 2.5, F.lit(False)),
        }
    ).drop("_gap", "_tr", "_v20", "_tr20")


def multiple_testing(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """V20. Bonferroni, Holm, and Benjamini-Hochberg-Yekutieli decisions. The tests are a report's rows: few."""
    df = tests.filter(F.col(p).isNotNull())
    w = Window.partitionBy(F.lit(0))
    m, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(p, *[c for c in df.columns if c != p]))
    df = df.withColumns({"_m": m, "_k": k})
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda s, j: s + 1.0 / j)
    df = df.withColumns({"_holm": (F.col(p) <= alpha / (F.col("_m") - F.col("_k") + 1)).cast("int"), "_bhy": F.when(F.col(p) <= F.col("_k") * alpha / (F.col("_m") * harmonic), F.col("_k"))})
    # Holm stops at the first failure; BHY keeps all up to the last success
    up = w.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"bonferroni": F.col(p) * F.col("_m") <= alpha, "holm": F.min("_holm").over(up) == 1, "bhy": F.col("_k") <= F.coalesce(F.max("_bhy").over(w), F.lit(0))}).drop("_m", "_k", "_holm", "_bhy")


def normal_p_value(t: Column) -> Column:
    """Two-sided p-value of a large-sample t-statistic, by Abramowitz and Stegun's formula 26.2.17. Its coefficients."""
    x = F.abs(t)
    k = 1 / (1 + 0.2316419 * x)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return 2 * F.exp(-x * x / 2) / 2.5066282746310002 * poly


def bootstrap_interval(df: DataFrame, value: str, order: Sequence[str], rounds: int = 200, seed: str = "boot", level: float = 0.95, group: Sequence[str] = ("symbol",)) -> DataFrame:
    """V22. Percentile interval of a group's mean under resampling with replacement.

    Each row enters each round as often as its Poisson draw says, the limit of drawing n
    of n with replacement, so that no row numbers, joins or shuffles of rows are needed.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*group, *[c for c in order if c not in group], F.col(value).alias("_v"))
    many = dealt_out(rows, *order).select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u, weight, total, term = draw(seed, "round", *order), F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        weight = weight + F.when(u >= total, 1).otherwise(0)
        term /= k + 1
    many = many.withColumn("_w", weight)
    means = many.groupBy(*group, "round").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("m"))
    return means.groupBy(*group).agg(F.count("m").alias("rounds"), F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))


def walk_forward(bounds: DataFrame, train: int = 24, validate: int = 6, test: int = 6) -> DataFrame:
    """V23. Months of each epoch: training, validation and test spans that move on by the test span.

    bounds: one row (first, last) of dates; spans run over whole months, and the last epoch is the last whole one.
    """
    bounds = bounds.select(F.trunc("first", "month").alias("a"), F.add_months(F.trunc("last", "month"), 1).alias("z"))
    steps = F.floor((F.months_between("z", "a") - train - validate) / test).cast("int")
    df = bounds.withColumn("_n", steps).filter("_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.add_months("a", F.col("epoch") * test)
    spans = [("train", 0, train), ("validation", train, train + validate), ("test", train + validate, train + validate + test)]
    return df.select("epoch", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.add_months(start, b).alias("from_date"), F.add_months(start, e).alias("to_date")) for r, b, e in spans])).alias("s")).select("epoch", "s.*")


def epoch_review(rows: DataFrame, ret: str = "returns") -> DataFrame:
    """V23. Metrics of each epoch and role, and whether the epoch is promoted: a positive mean in validation and in test."""
    x = F.col(ret)
    df = rows.groupBy("epoch", "role").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_return"), F.stddev_pop(x).alias("std_return"), F.avg((x > 0).cast("double")).alias("hit_rate"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    good = F.when((F.col("role") != "train") & (F.col("mean_return") > 0), 1).otherwise(0)
    return df.withColumn("promoted", F.sum(good).over(Window.partitionBy("epoch")) == 2)


def in_epochs(df: DataFrame, epochs: DataFrame) -> DataFrame:
    """Rows with their epochs and roles; the epochs are few."""
    return df.join(F.broadcast(epochs), (F.col("date") >= F.col("from_date")) & (F.col("date") < F.col("to_date")))


def forbidden_language(docs: DataFrame, tokens: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """V19, P8. Documents that hold any of a fixed list of tokens, with those tokens; a projection, no join."""
    low = F.lower(text_col)
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in tokens]))
    return docs.select(id_col, hits.alias("hits")).filter(F.size("hits") > 0).select(id_col, F.explode("hits").alias("token"))


def ledger_invariants(observations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """V18, P10, P11, O6. One row of checks on two ledgers (observation_id, symbol, outcome_status, sent_to_broker, broker_order_id)."""
    from qpanel.functions.text import is_empty_token, is_true_token

    a = observations.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.lower("outcome_status") == "pending").alias("pending"), F.countDistinct("observation_id").alias("distinct_ids"), F.count_if(is_true_token(F.col("sent_to_broker"))).alias("sent"), F.count_if(~is_empty_token(F.col("broker_order_id"))).alias("with_order"), F.collect_set("symbol").alias("symbols"))
    b = outcomes.agg(F.count(F.lit(1)).alias("outcomes"), F.collect_set("symbol").alias("outcome_symbols"))
    df = a.join(F.broadcast(b))
    return df.select("total", "pending", (F.col("total") - F.col("pending")).alias("resolved"), (F.col("total") - F.col("distinct_ids")).alias("duplicate_ids"), "sent", "with_order", "outcomes", (F.col("total") == F.col("outcomes")).alias("same_rows"), (F.size(F.array_except("symbols", "outcome_symbols")) + F.size(F.array_except("outcome_symbols", "symbols"))).alias("symbols_apart"))
