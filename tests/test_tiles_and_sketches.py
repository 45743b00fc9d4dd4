"""Correlations by tiles against a loop over pairs, and merged sketches against all values."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qpanel.operators import joins
from qpanel.sources import store


def returns_of(n_symbols, n_days, seed):
    rng, rows = random.Random(seed), []
    for k in range(n_days):
        market = rng.gauss(0, 1)
        for s in range(n_symbols):
            if rng.random() > 0.1:
                rows.append((f"S{s}", datetime.date(2020, 1, 1) + datetime.timedelta(k), None if rng.random() < 0.05 else 0.0 if s == 3 else market * (s % 3) + rng.gauss(0, 1)))
    return rows


@pytest.mark.parametrize(("blocks", "candidates"), [(1, 0.0), (3, 0.0), (50, 0.0), (3, 0.4)])
def test_tiles_give_each_pair_once(spark, blocks, candidates):
    rows, w = returns_of(7, 40, 1), 10
    df = spark.createDataFrame(rows, "symbol string, date date, returns double").repartition(5)
    got = {(r["a"], r["b"], r["date"]): r["corr"] for r in joins.pair_correlations(df, w, blocks, candidates).collect()}
    x = {s: {d: r for t, d, r in rows if t == s and r is not None} for s in {r[0] for r in rows}}
    want = {}
    for a in x:
        for b in x:
            days = sorted(set(x[a]) & set(x[b]))
            if a < b and len(days) >= w:
                p, q = np.array([x[a][d] for d in days]), np.array([x[b][d] for d in days])
                whole = 0 if p.std() * q.std() == 0 else np.corrcoef(p, q)[0, 1]
                if candidates and abs(whole) < candidates:
                    continue
                for k in range(w - 1, len(days)):
                    u, v = p[k - w + 1 : k + 1], q[k - w + 1 : k + 1]
                    want[a, b, days[k]] = None if u.std() * v.std() == 0 else np.corrcoef(u, v)[0, 1]
    assert got.keys() == want.keys() and len(got) > 30
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-9)


def test_spikes_are_jumps_against_own_history(spark):
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(k)
    corr = spark.createDataFrame([("A", "B", day(k), 0.9 if k == 30 else 0.1 + 0.01 * (k % 2)) for k in range(40)], "a string, b string, date date, corr double")
    panel = spark.createDataFrame([("A", day(k), (0.001 if k < 20 else 0.05) * (-1) ** k) for k in range(40)], "symbol string, date date, returns double")
    got = {r["date"]: (r["spike"], r["regime"]) for r in joins.correlation_regimes(corr, panel, history=10, vol_window=5).collect()}
    assert [k for k in range(40) if got[day(k)][0]] == [30] and got[day(9)][0] is None
    assert got[day(3)][1] is None and got[day(10)][1] == "low" and got[day(25)][1] == "high"


def test_sketches_of_versions_merge(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"S{k % 5}", datetime.date(2020, 1, 1) + datetime.timedelta(k // 5), None if k % 50 == 0 else round(rng.gauss(0, 1), 3), float(k % 7)) for k in range(6000)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double, y double")
    s = store.FeatureStore(spark, str(tmp_path))
    half = F.col("date") < datetime.date(2021, 6, 1)
    for version, part in (("a", half), ("b", ~half)):
        s.write(df.filter(part), {"x": "one", "y": "two"}, version)
    both = {r["feature"]: r for r in s.distributions([0.1, 0.5, 0.9], ["a", "b"]).collect()}
    x = np.array([r[2] for r in rows if r[2] is not None])
    assert (both["x"]["n_values"], both["x"]["n_nan"]) == (6000, 120)
    for p, cut in zip((0.1, 0.5, 0.9), both["x"]["percentiles"]):
        assert abs((x <= cut).mean() - p) < 0.02
    assert abs(both["x"]["n_distinct"] - len(np.unique(x))) < 0.06 * len(np.unique(x)) and both["y"]["n_distinct"] == 7
    one = {r["feature"]: r["n_values"] for r in s.distributions(versions=["a"]).collect()}
    assert one["x"] == df.filter(half).count()
    assert s.distributions(by=("feature", "symbol")).count() == 10
    # the values are not read
    assert all("/catalog/" in f for f in s.distributions().inputFiles())
