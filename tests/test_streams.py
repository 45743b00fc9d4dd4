"""Ordered state across micro-batches: deliveries in any order give what one pass over the ordered rows gives."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qpanel.functions import kernels
from qpanel.streaming import feeds

T0 = datetime.datetime(2024, 1, 1)
TICKS = "event_id long, ts timestamp, symbol string, price double, user_id long"


def ticks(n, seed):
    rng, t, rows = random.Random(seed), T0, []
    for k in range(n):
        t += datetime.timedelta(seconds=rng.choice([0, 20, 60, 300, 5000]))
        rows.append((k, t, rng.choice("AB"), round(rng.uniform(1, 50), 2), 0))
    return rows


def streamed(spark, tmp_path, deliveries, make):
    for k, rows in enumerate(deliveries):
        spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(TICKS).parquet(f"{tmp_path}/in")
        found = feeds.run_available(make(s), f"{tmp_path}/out", f"{tmp_path}/state")
    return found


def shuffled(rows, seed, parts, repeats):
    rng = random.Random(seed)
    out = [[] for _ in range(parts)]
    for r in rows:
        out[rng.randrange(parts)].append(r)
        if rng.random() < repeats:
            out[rng.randrange(parts)].append(r)
    for p in out:
        rng.shuffle(p)
    return out


@pytest.mark.parametrize("span", [feeds.MINUTE, 500 * feeds.MINUTE])
def test_any_order_gives_the_batch_kernels_values(spark, tmp_path, span):
    rows = ticks(120, 1)
    end = (999, rows[-1][1] + datetime.timedelta(days=40), "Z", 1.0, 0)
    deliveries = [*shuffled(rows, 2, 2, 0.3), [end]]
    found = streamed(spark, tmp_path, deliveries, lambda t: feeds.running_features(t, "30 days", span)).collect()
    for symbol in "AB":
        own = sorted((r for r in rows if r[2] == symbol), key=lambda r: (r[1], r[0]))
        price = np.array([r[3] for r in own])
        got = sorted((r for r in found if r["symbol"] == symbol), key=lambda r: (r["ts"], r["price"]))
        assert sorted((r["ts"], r["price"]) for r in got) == sorted((r[1], r[3]) for r in own)
        by_row = {(r["ts"], r["price"]): r for r in got}
        ema, rsi = kernels.ema(price, 10), kernels.rsi(price, 14)
        up = 0
        for k, r in enumerate(own):
            g = by_row[r[1], r[3]]
            up = up + 1 if k and price[k] > price[k - 1] else 0
            assert g["run_up"] == up
            assert (g["ema_10"] is None) == bool(np.isnan(ema[k])) and (g["ema_10"] is None or abs(g["ema_10"] - ema[k]) < 1e-9)
            assert (g["rsi_14"] is None) == bool(np.isnan(rsi[k])) and (g["rsi_14"] is None or abs(g["rsi_14"] - rsi[k]) < 1e-9)


def test_rows_behind_the_watermark_are_lost_and_others_wait(spark, tmp_path):
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    first = [(1, at(0), "A", 1.0, 0), (2, at(30), "A", 2.0, 0)]
    # the watermark is at 20 minutes now: 5 minutes is too late, 25 isn't
    second = [(3, at(5), "A", 9.0, 0), (4, at(25), "A", 3.0, 0), (2, at(30), "A", 2.0, 0)]
    third = [(5, at(50), "A", 4.0, 0)]
    found = streamed(spark, tmp_path, [first, second, third], lambda t: feeds.running_features(t, "10 minutes", 7 * feeds.MINUTE))
    assert sorted((r["ts"], r["price"], r["run_up"]) for r in found.collect()) == [(at(0), 1.0, 0), (at(25), 3.0, 1), (at(30), 2.0, 0)]


def test_alarms_in_any_order_once_each(spark, tmp_path):
    rows = ticks(80, 5)
    end = rows[-1][1] + datetime.timedelta(days=40)
    found = streamed(spark, tmp_path, [*shuffled(rows, 3, 2, 0.4), [(999, end, "Z", 1.0, 0)]], lambda t: feeds.stale_alarms(t, "30 days", 90 * feeds.MINUTE)).collect()
    hour, want = datetime.timedelta(hours=1), []
    for symbol in "AB":
        own = sorted(r[1] for r in rows if r[2] == symbol)
        want += [(symbol, a, a + hour) for a, b in zip(own, [*own[1:], end]) if b - a >= hour]
    assert sorted((r["symbol"], r["last_tick"], r["alarm_at"]) for r in found) == sorted(want)


def test_bars_meet_the_signals_of_their_hours_alone(spark, tmp_path):
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    rng, hour = random.Random(4), 3600
    # some on the edges of hours and spans, some twice
    seconds = sorted([0, 0, hour, 4 * hour, 8 * hour - 1, *[rng.randrange(90 * hour) for _ in range(400)]])
    rows = [(k, at(s), symbol, float(k), 0) for symbol in "AB" for k, s in enumerate(seconds)]
    end = (9999, at(400 * hour), "Z", 1.0, 0)
    make = lambda t: feeds.signals_with_bars(t.select("symbol", F.col("ts").alias("signal_ts")), feeds.closed_bars(t))
    found = streamed(spark, tmp_path, [[*rows, end]], make)
    closes = {}
    for k, t, symbol, price, _ in rows:
        closes[symbol, t - datetime.timedelta(minutes=t.minute, seconds=t.second) + datetime.timedelta(hours=1, microseconds=-1)] = price
    want = [(r[2], r[1], t, c) for r in rows for (symbol, t), c in closes.items() if symbol == r[2] and r[1] < t <= r[1] + datetime.timedelta(hours=4)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    s = spark.readStream.schema(TICKS).parquet(f"{tmp_path}/in")
    q = make(s)._jdf.queryExecution().analyzed().toString()
    assert "_stretch" in next(line for line in q.splitlines() if "Join Inner" in line)


class Kept:
    """A state in memory that counts its calls: of one value, or of a map."""

    def __init__(self, calls):
        self.calls, self.map = calls, {}

    def counted(f):
        def call(self, *a):
            self.calls.append(f.__name__)
            return f(self, *a)

        return call

    exists = counted(lambda self: None in self.map)
    get = counted(lambda self: self.map[None])
    update = counted(lambda self, v: self.map.update({None: v}))
    clear = counted(lambda self: self.map.clear())
    keys = counted(lambda self: iter(list(self.map)))
    containsKey = counted(lambda self, k: k in self.map)
    getValue = counted(lambda self, k: self.map.get(k))
    updateValue = counted(lambda self, k, v: self.map.update({k: v}))
    removeKey = counted(lambda self, k: self.map.pop(k))


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getMapState(self, *a):
        return Kept(self.calls)

    getValueState = getMapState

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_is_called_for_blocks_of_rows_not_for_spans_of_chunks():
    rng, n, minutes = np.random.default_rng(3), 60_000, 20_000
    us = rng.integers(1, minutes * 60, n) * 1_000_000
    us[:25_000] = us[0]
    rows = pd.DataFrame({"ts": pd.to_datetime(us, unit="us"), "event_id": rng.permutation(n), "price": rng.integers(1, 99, n).astype(float)})
    rows = rows.sample(frac=1, random_state=1)
    p, h = feeds.RunningFeatures(), Handle()
    p.run, p.step = 20_000, 7_000
    p.init(h)
    chunks = [rows[k : k + 1000] for k in range(0, n, 1000)]
    list(p.handleInputRows(("A",), iter(chunks[:40]), At(0)))
    # some are repeated, and the watermark stops within the rows before the last are due
    list(p.handleInputRows(("A",), iter(chunks[30:]), At(0)))
    found = []
    for ms in (minutes * 20_000, minutes * 40_000, minutes * 60_000):
        assert min(h.timers) <= ms
        h.timers.clear()
        found += list(p.handleExpiredTimer(("A",), At(ms), None))
    assert not h.timers and not p.buffer.map
    assert len(h.calls) < n // 100
    got, want = pd.concat(found), rows.sort_values(["ts", "event_id"])
    assert got["ts"].tolist() == want["ts"].tolist() and got["price"].tolist() == want["price"].tolist()
    assert np.allclose(got["ema_10"].to_numpy(), kernels.ema(want["price"].to_numpy(), 10), equal_nan=True)
