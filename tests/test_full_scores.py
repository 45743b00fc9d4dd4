"""Scores of all pairs, correlations, clusters, draws and baselines against the single operators and plain loops."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from qpanel.functions import kernels
from qpanel.operators import scoring, validation

NAMES, LABELS = ["up", "noise", "steps", "gaps", "same"], ["forward_return_5d", "late", "class"]


@pytest.fixture(scope="module")
def wide(spark):
    rng, rows = random.Random(7), []
    for s, n in (("A", 620), ("B", 130), ("C", 30)):
        for k in range(n):
            y = rng.gauss(0, 1)
            x = [y + rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randint(0, 4)), None if k < 40 else rng.choice([y, float("inf")]) if k % 9 == 0 else rng.gauss(0, 1), 3.0]
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(k), *x, y if k < n - 5 else None, y + rng.gauss(0, 2) if k < n - 20 else None, float(rng.randint(-1, 1))))
    return spark.createDataFrame(rows, "symbol string, date date, up double, noise double, steps double, gaps double, same double, forward_return_5d double, late double, class double").repartition(4)


def close(a, b):
    return (a is None or math.isnan(a)) and (b is None or (isinstance(b, float) and math.isnan(b))) if a is None or b is None else abs(a - b) < 1e-9


def test_all_scores_are_those_of_the_single_operators(wide):
    got = {(r["symbol"], r["feature"], r["label"]): r for r in scoring.all_scores(wide, NAMES, LABELS).collect()}
    want = {(r["symbol"], r["feature"], r["label"]): r for r in scoring.score(wide, NAMES, LABELS).collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 15 - 3  # C has no gap-free rows beyond the warm-up
    for k, w in want.items():
        for c in ("n_obs", "n_total", "status"):
            assert got[k][c] == w[c], (k, c)
        for c in ("rank_ic", "ic_t_stat", "mutual_information", "decile_spread", "top_decile_return", "bottom_decile_return", "missing_rate", "ic_std", "ic_min", "ic_max"):
            assert close(got[k][c], w[c]), (k, c, got[k][c], w[c])
        assert got[k]["unstable"] == bool(w["unstable"])
    assert got["A", "gaps", "class"]["inf_rate"] > 0 and got["A", "up", "late"]["inf_rate"] == 0


def test_wide_correlations_and_clusters(wide):
    df = wide.withColumn("twin", F.col("up") * 2 + 1e9).withColumn("gaps", F.when(F.col("gaps") < float("inf"), F.col("gaps")))
    names = [*NAMES, "twin"]
    got = {(r["a"], r["b"]): r for r in validation.wide_correlations(df, names).collect()}
    for r in validation.correlation_pairs(df, names).collect():
        g = got[r["a"], r["b"]]
        assert g["n"] == r["n"] and abs(g["r"] - r["r"]) < 1e-6
    rows = validation.cluster_rows(validation.wide_correlations(df, names), names).collect()
    assert {(r["cluster"], r["feature"], r["by_variance"]) for r in rows} == {("up", "up", "twin"), ("up", "twin", "twin")}


def test_validation_report(wide):
    scores = scoring.all_scores(wide, NAMES, LABELS)
    rows = validation.cluster_rows(validation.wide_correlations(wide, NAMES), NAMES)
    r = scoring.validation_report(scores, rows, 0, k=2).first()
    assert r["n_pairs"] == 42 and r["n_features"] == 5 and r["lookahead_status"] == "PASS" and r["overall"] == "OK"
    assert len(r["top"]) == 2 and "up" in r["top"] and r["n_blocked"] + r["n_dead"] + r["n_weak"] + r["n_candidate"] == 42
    assert scoring.validation_report(scores, rows, 3).first()["overall"] == "BLOCKED"


def u(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13


@pytest.mark.parametrize("buckets", [1, 7, 256])
def test_random_pruning_is_a_sort_of_all(spark, buckets):
    rows = [("s" if k % 3 else "t", f"S{k % 5}", k, float(k % 17)) for k in range(200)]
    size = {"s": 31, "t": 500}
    pool = spark.createDataFrame([(*r, size[r[0]]) for r in rows], "strategy string, symbol string, date int, ret double, k int")
    got = {(r["strategy"], r["perm"]): (r["draw_mean"], r["n_drawn"]) for r in validation.random_pruning(pool, F.col("k"), 12, first=3, buckets=buckets).collect()}
    want = {}
    for s in ("s", "t"):
        for p in range(3, 13):
            drawn = sorted((u("prune", p, r[1], r[2]), r[3]) for r in rows if r[0] == s)[: size[s]]
            want[s, p] = (np.mean([v for _, v in drawn]), len(drawn))
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_two_stage_pruning(spark):
    rows = [("good", "S", k, float(k % 10), 20) for k in range(200)] + [("bad", "S", k, float(k % 10), 20) for k in range(200)]
    pool = spark.createDataFrame(rows, "strategy string, symbol string, date int, ret double, k int")
    actual = spark.createDataFrame([("good", 9.0), ("bad", 1.0)], "strategy string, filtered_mean double")
    got = {r["strategy"]: r for r in validation.two_stage_pruning(pool, F.col("k"), actual, (20, 60)).collect()}
    assert got["good"]["verdict"] == "BEATS" and got["good"]["perms"] == 60 and got["bad"]["first_verdict"] == "FAILS" and got["bad"]["perms"] == 20


def test_null_baselines_are_small_and_of_all_labels(wide):
    got = {(r["label"], r["baseline"]): r for r in validation.null_baselines(wide.filter("symbol = 'A'"), "up", LABELS, perms=15).collect()}
    assert len(got) == 6 and all(r["n"] == 15 and r["mean_abs_ic"] < 0.1 and r["p95_abs_ic"] >= r["mean_abs_ic"] for r in got.values())


def test_duplicates_walk_forward_and_splits(spark):
    r = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "strategy string, m int")
    assert sorted(map(tuple, validation.duplicate_results(r, ["m"]).collect())) == [(1, "a", "a", 2), (1, "b", "a", 2)]
    bounds = spark.sql("SELECT DATE '2010-03-15' AS first, DATE '2014-02-20' AS last")
    found = validation.walk_forward(bounds).orderBy("from_date", "to_date").collect()
    assert len(found) == 9 and found[0]["from_date"] == dt.date(2010, 3, 1) and max(x["to_date"] for x in found) == dt.date(2014, 3, 1)
    rows = validation.multi_horizon_splits(spark, 500, (1, 20)).collect()
    by = defaultdict(list)
    for x in rows:
        by[x["horizon"]].append(x)
    assert len(by[1]) == len(by[20]) == 5 and not any(x["overlaps"] for x in rows) and by[1][0]["n_train"] == by[20][0]["n_train"] + 38


def test_hurst_loses_only_windows_with_a_bad_close():
    rng = np.random.default_rng(3)
    close_ = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 400)))
    whole, bad = kernels.hurst(close_), close_.copy()
    bad[150] = 0.0
    cut = kernels.hurst(bad)
    same = np.r_[100:150, 251:400]
    assert np.array_equal(cut[same], whole[same]) and np.isnan(cut[150:251]).all()
