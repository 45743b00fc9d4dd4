"""Restated fundamentals, quotes of venues, order statistics, first passages and binomial tests against plain loops and exact sums."""

from __future__ import annotations

import datetime
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from qpanel.functions import binomial, orders
from qpanel.operators import fundamentals, joins, labels, regime

D = datetime.date


def facts_of(seed):
    """Reports, restatements and estimates of quarters at random times, some at one time, some missing, some out of order."""
    rng = random.Random(seed)
    ends = [D(2018, 3, 31), D(2018, 6, 30), D(2018, 9, 30), D(2018, 12, 31), D(2019, 3, 31), D(2019, 6, 30), D(2019, 9, 30), D(2019, 12, 31), D(2020, 3, 31)]
    facts, estimates = [], []
    for s in "AB":
        for p in ends:
            for _ in range(rng.randint(0, 3)):
                facts.append((s, p, p + datetime.timedelta(rng.choice([10, 30, 30, 45, 100, 250, 400])), float(rng.randint(1, 9))))
            for _ in range(rng.randint(0, 3)):
                estimates.append((s, p, p + datetime.timedelta(rng.choice([-20, 5, 10, 30, 45, 60])), float(rng.randint(0, 9))))
    facts += [(None, ends[0], ends[0], 1.0), ("A", None, ends[0], 1.0), ("A", ends[0], None, 1.0), ("A", ends[0], ends[0], None)]
    return facts, estimates


def plain_context(facts, estimates, s, d):
    def latest(rows, period, before):
        rows = [r for r in rows if r[0] == s and r[1] == period and r[2] is not None and r[3] is not None and before(r[2])]
        return max(rows, key=lambda r: (r[2], r[3]))[3] if rows else None

    known = [r for r in facts if r[0] == s and None not in r and r[2] <= d]
    if not known:
        return None, None, None, None, None
    period = max(r[1] for r in known)
    reported = min(r[2] for r in known if r[1] == period)
    first = max(r[3] for r in known if r[1] == period and r[2] == reported)
    value, estimate = latest(facts, period, lambda k: k <= d), latest(estimates, period, lambda k: k < reported)
    year = D(period.year - 1, period.month, period.day)
    base = latest(facts, year, lambda k: k <= d)
    return period, value, None if not estimate else (first - estimate) / abs(estimate), None if not base or base <= 0 else value / base - 1, (d - reported).days


@pytest.mark.parametrize("seed", range(4))
def test_fundamentals_are_those_known_then(spark, seed):
    facts, estimates = facts_of(seed)
    days = [(s, D(2018, 1, 1) + datetime.timedelta(11 * k)) for s in "ABC" for k in range(110)]
    schema = "symbol string, period date, known date, {} double"
    out = fundamentals.fundamental_context(spark.createDataFrame(days, "symbol string, date date"), spark.createDataFrame(facts, schema.format("value")), spark.createDataFrame(estimates, schema.format("estimate")))
    got = {(r["symbol"], r["date"]): (r["period"], r["value"], r["surprise"], r["growth"], r["report_age"]) for r in out.collect()}
    assert len(got) == len(days)
    for s, d in days:
        want = plain_context(facts, estimates, s, d)
        assert got[s, d][:2] == want[:2] and got[s, d][4] == want[4], (s, d)
        assert got[s, d][2:4] == pytest.approx(want[2:4]), (s, d)


def test_a_restatement_does_not_leak_back(spark):
    p, y = D(2020, 3, 31), D(2019, 3, 31)
    facts = spark.createDataFrame([("A", y, D(2019, 5, 1), 10.0), ("A", p, D(2020, 5, 1), 20.0), ("A", y, D(2020, 6, 1), 5.0), ("A", p, D(2020, 7, 1), 40.0)], "symbol string, period date, known date, value double")
    est = spark.createDataFrame([("A", p, D(2020, 4, 1), 16.0), ("A", p, D(2020, 5, 1), 99.0)], "symbol string, period date, known date, estimate double")
    days = spark.createDataFrame([("A", D(2020, 5, 2)), ("A", D(2020, 6, 2)), ("A", D(2020, 7, 2))], "symbol string, date date")
    got = [(r["value"], r["growth"], r["surprise"]) for r in fundamentals.fundamental_context(days, facts, est).orderBy("date").collect()]
    assert got == [(20.0, 1.0, 0.25), (20.0, 3.0, 0.25), (40.0, 7.0, 0.25)]


def test_venue_spread_is_that_of_all_pairs(spark):
    rng, t, rows = random.Random(4), datetime.datetime(2024, 1, 1, 20), []
    for _ in range(400):
        t += datetime.timedelta(minutes=rng.choice([0, 1, 7, 90]))
        bid = round(rng.uniform(99, 101), 3)
        rows.append((rng.choice("XY"), rng.choice("abc"), t, bid, bid + rng.choice([0.01, 0.2])))
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "symbol string, venue string, ts timestamp, bid double, ask double").repartition(3)
    got = sorted((r["symbol"], r["ts"], round(r["net_spread"], 9)) for r in joins.venue_spread(df, ["a", "b", "c"], stale="2 hours").collect())
    want = []
    for s, v, at, _, _ in rows:
        seen = {}
        for r in sorted(rows, key=lambda r: (r[2], r[1])):
            if r[0] == s and (r[2], r[1]) <= (at, v):
                seen[r[1]] = r
        fresh = [r for r in seen.values() if r[2] >= at - datetime.timedelta(hours=2)]
        nets = [a[3] * 0.999 / (b[4] * 1.001) - 1 for a in fresh for b in fresh if a[1] != b[1]]
        if nets:
            want.append((s, at, round(max(nets), 9)))
    assert got == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 64, 100, 257])
def test_order_statistics_are_counts(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 20, n).astype(float)
    x[rng.random(n) < 0.2] = np.nan
    want = [0 if np.isnan(v) else int(np.sum(x[: k + 1] <= v)) for k, v in enumerate(x)]
    assert orders.at_most_so_far(x).tolist() == want
    got = orders.expanding_percentile(x, 5)
    for k, v in enumerate(x):
        seen = int(np.sum(~np.isnan(x[: k + 1])))
        assert np.isnan(got[k]) if np.isnan(v) or seen < 5 else got[k] == want[k] / seen


@pytest.mark.parametrize("n", [0, 1, 2, 5, 16, 33, 200])
@pytest.mark.parametrize("horizon", [1, 2, 3, 7, 8, 45, 1000])
def test_first_passages_are_those_of_a_loop(n, horizon):
    rng = np.random.default_rng(n + horizon)
    x, level = np.cumsum(rng.normal(size=n)), np.cumsum(rng.normal(size=n)) - 2
    x[rng.random(n) < 0.1], level[rng.random(n) < 0.1] = np.nan, np.nan
    for f, hit in ((orders.first_at_most, lambda a, b: a <= b), (orders.first_at_least, lambda a, b: a >= b)):
        got = f(x, level, horizon)
        for k in range(n):
            want = next((j - k for j in range(k + 1, min(n, k + horizon + 1)) if hit(x[j], level[k])), None)
            assert np.isnan(got[k]) if want is None else got[k] == want


def test_passages_and_percentiles_on_a_panel(spark):
    rows = [("A", D(2020, 1, k), 10.0, h, lo) for k, h, lo in ((1, 10.5, 9.5), (2, 10.6, 9.6), (3, 12.5, 9.9), (4, 10.2, 7.5), (5, 13.0, 7.0))]
    df = spark.createDataFrame(rows, "symbol string, date date, close double, high double, low double")
    found = labels.first_passages(df, F.col("close") - 2, F.col("close") + 2, 2).orderBy("date").collect()
    assert [(r["bars_to_stop"], r["bars_to_profit"], r["hit"]) for r in found] == [(None, 2.0, "profit"), (2.0, 1.0, "profit"), (1.0, 2.0, "stop"), (1.0, 1.0, "stop"), (None, None, None)]
    r = labels.passage_report(labels.first_passages(df, F.col("close") - 2, F.col("close") + 2, 2)).first()
    assert (r["n"], r["stop_hit_rate"], r["profit_rate"], r["mean_bars_to_profit"], r["median_bars_to_profit"]) == (4, 0.5, 0.5, 1.5, 1.5)
    p = regime.expanding_percentiles(df, {"x": "high"}, 3).orderBy("date").collect()
    assert [r["x"] for r in p] == [None, None, 1.0, 0.25, 1.0]


def exact_tail(k, n, p):
    return float(sum(Fraction(math.comb(n, j)) * p**j * (1 - p) ** (n - j) for j in range(max(k, 0), n + 1)))


def test_tails_are_exact_sums():
    for n in (1, 2, 5, 30, 200):
        for k in sorted({0, 1, n // 3, n // 2, n - 1, n, n + 1}):
            for p in (Fraction(1, 2), Fraction(1, 100), Fraction(9, 10)):
                got = float(binomial.upper_tail(np.array([k]), np.array([n]), np.array([float(p)]))[0])
                assert got == pytest.approx(exact_tail(k, n, p), rel=1e-10, abs=1e-305), (n, k, p)
    # far out in the tail, where sums of likely values would say 0
    got = float(binomial.upper_tail(np.array([950]), np.array([1000]), np.array([0.5]))[0])
    assert got == pytest.approx(exact_tail(950, 1000, Fraction(1, 2)), rel=1e-10) and 0 < got < 1e-200
    got = float(binomial.upper_tail(np.array([995]), np.array([1000]), np.array([0.5]))[0])
    assert got == pytest.approx(exact_tail(995, 1000, Fraction(1, 2)), rel=1e-9) and got < 1e-280


def test_hit_rate_rows(spark):
    df = spark.createDataFrame([(7, 10), (0, 10), (10, 10), (500, 1000), (0, 0), (None, 5), (3, None)], "k long, n long")
    got = {(r["k"], r["n"]): r["t"] for r in df.withColumn("t", binomial.hit_rate_test("k", "n")).collect()}
    assert got[7, 10]["p_upper"] == pytest.approx(176 / 1024) and got[7, 10]["p_value"] == pytest.approx(352 / 1024) and got[500, 1000]["p_value"] == 1.0
    for k, n in ((7, 10), (500, 1000)):
        t = got[k, n]
        assert exact_tail(k, n, Fraction(t["low"])) == pytest.approx(0.025, rel=1e-9) and 1 - exact_tail(k + 1, n, Fraction(t["high"])) == pytest.approx(0.025, rel=1e-9)
    assert got[0, 10]["low"] == 0 and got[10, 10]["high"] == 1 and got[0, 10]["high"] == pytest.approx(1 - 0.025**0.1)
    assert [got[x]["p_value"] for x in ((0, 0), (None, 5), (3, None))] == [None] * 3
