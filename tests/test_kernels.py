"""Recursions against plain loops written from their definitions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from qpanel.functions import kernels as k

rng = np.random.default_rng(0)
CLOSE = np.exp(np.cumsum(rng.normal(0, 0.02, 260))) * 50
HIGH, LOW = CLOSE * (1 + rng.random(260) * 0.02), CLOSE * (1 - rng.random(260) * 0.02)


def same(a, b):
    np.testing.assert_allclose(np.array(a, dtype=float), np.array(b, dtype=float), rtol=1e-9, equal_nan=True)


def loop_ema(x, p):
    out, value, seen = [math.nan] * len(x), None, []
    for n, v in enumerate(x):
        if math.isnan(v):
            continue
        if value is None:
            seen.append(v)
            if len(seen) == p:
                value = sum(seen) / p
                out[n] = value
        else:
            value += 2 / (p + 1) * (v - value)
            out[n] = value
    return out


@pytest.mark.parametrize("p", [1, 9, 20])
def test_ema(p):
    same(k.ema(CLOSE, p), loop_ema(CLOSE, p))
    same(k.ema(np.r_[[np.nan] * 25, CLOSE], p), loop_ema(np.r_[[np.nan] * 25, CLOSE], p))
    assert np.isnan(k.ema(CLOSE[: p - 1], p)).all()


def test_macd_signal_is_seeded_on_valid_values():
    class Bars:
        close = CLOSE

    signal = k.KERNELS["macd_signal"](Bars)
    assert np.isnan(signal[:33]).all() and not np.isnan(signal[33:]).any()


@pytest.mark.parametrize("p", [2, 14])
def test_rsi(p):
    step = np.diff(CLOSE)
    up, down = np.maximum(step, 0), np.maximum(-step, 0)
    gain, loss, out = up[:p].mean(), down[:p].mean(), [math.nan] * p
    for n in range(p, len(CLOSE)):
        out.append(100.0 if loss == 0 else 100 - 100 / (1 + gain / loss))
        if n < len(step):
            gain, loss = (gain * (p - 1) + up[n]) / p, (loss * (p - 1) + down[n]) / p
    same(k.rsi(CLOSE, p), out)
    assert k.rsi(np.arange(1.0, 40), p)[-1] == 100


def test_atr():
    tr = [0.0] + [max(HIGH[n] - LOW[n], abs(HIGH[n] - CLOSE[n - 1]), abs(LOW[n] - CLOSE[n - 1])) for n in range(1, len(CLOSE))]
    value, out = sum(tr[1:8]) / 7, [math.nan] * 7
    out.append(value)
    for n in range(8, len(tr)):
        value = (value * 6 + tr[n]) / 7
        out.append(value)
    same(k.atr(HIGH, LOW, CLOSE, 7), out)


def test_hurst():
    def one(segment):
        r = np.diff(np.log(segment))
        points = []
        for size in (10, 20, 40, 60):
            ratios = []
            for s in range(0, len(r) - size + 1, size):
                chunk = r[s : s + size]
                walk = np.cumsum(chunk - chunk.mean())
                ratios.append((walk.max() - walk.min()) / (chunk.std() or 0.001))
            points.append((math.log(size), math.log(np.mean(ratios))))
        x, y = np.array(points).T
        return min(1.0, max(0.0, np.polyfit(x, y, 1)[0]))

    got = k.hurst(CLOSE)
    assert np.isnan(got[:100]).all()
    same(got[100:], [one(CLOSE[n - 100 : n + 1]) for n in range(100, len(CLOSE))])


def test_half_life():
    bench = rng.normal(0, 0.01, 200)
    stock = 0.001 + 1.3 * bench + rng.normal(0, 0.01, 200)
    got = k.half_life(stock, bench)
    assert np.isnan(got[:60]).all()
    for n in (60, 100, 199):
        s, e = stock[n - 59 : n + 1], bench[n - 59 : n + 1]
        beta, alpha = np.polyfit(e, s, 1)
        walk = np.cumsum(s - alpha - beta * e)
        b = np.polyfit(walk[:-1], np.diff(walk), 1)[0]
        assert got[n] == pytest.approx(math.inf if b >= 0 else -math.log(2) / b, rel=1e-6)


def test_catalogue_recursions():
    class Bars:
        close, high, low = CLOSE, HIGH, LOW

    values = {n: k.KERNELS[n](Bars) for n in ("tema_20", "trix_15", "tsi_25_13", "ppo_12_26", "kama_10", "supertrend_10_3", "psar")}
    assert all(len(v) == len(CLOSE) and not np.isnan(v[60:]).any() for v in values.values())
    assert values["kama_10"][10:].min() >= CLOSE.min() and values["kama_10"][10:].max() <= CLOSE.max()
    assert np.abs(values["tsi_25_13"][60:]).max() <= 100
    rising = np.arange(10.0, 60.0)
    assert (k.parabolic_sar(rising + 1, rising)[2:] < rising[2:]).all() and (k.supertrend(rising + 1, rising, rising + 0.5, 10, 3.0)[12:] < rising[12:]).all()
    same(k.KERNELS["ppo_12_26"](Bars), 100 * (np.array(loop_ema(CLOSE, 12)) / np.array(loop_ema(CLOSE, 26)) - 1))
