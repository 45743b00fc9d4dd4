"""Principal components by products against a dense solver."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from qpanel.operators import factors


def panel_of(n_symbols, n_days, n_factors, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n_days, n_factors)) @ rng.normal(size=(n_factors, n_symbols)) + rng.normal(size=(n_days, n_symbols))
    x[rng.random(x.shape) < 0.1] = np.nan
    day = datetime.date(2020, 1, 1)
    rows = [(f"S{s}", day + datetime.timedelta(d), None if np.isnan(x[d, s]) else float(x[d, s])) for d in range(n_days) for s in range(n_symbols)]
    return x, rows


@pytest.mark.parametrize(("n_symbols", "n_days", "n_factors", "scale"), [(40, 60, 2, 1000.0), (70, 30, 0, 1e-3), (5, 20, 1, 1.0), (3, 20, 1, 1.0)])
def test_residuals_are_those_of_a_dense_solver(spark, n_symbols, n_days, n_factors, scale):
    x, rows = panel_of(n_symbols, n_days, n_factors, 7)
    x, rows = x * scale, [(s, d, None if r is None else r * scale) for s, d, r in rows]
    k = 3
    df = spark.createDataFrame(rows, "symbol string, date date, returns double").repartition(5)
    got = {(r["symbol"], r["date"]): r["factor_residual"] for r in factors.factor_residuals(df, k).collect()}
    c = np.nan_to_num(x - np.nanmean(x, axis=0))
    v = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :k]
    want = c - c @ v @ v.T
    assert len(got) == len(rows)
    for d in range(n_days):
        for s in range(n_symbols):
            r = got[f"S{s}", datetime.date(2020, 1, 1) + datetime.timedelta(d)]
            assert (r is None) if np.isnan(x[d, s]) else r == pytest.approx(want[d, s], abs=1e-6 * scale)


def test_no_returns_and_infinite_ones(spark):
    day = datetime.date(2020, 1, 1)
    none = spark.createDataFrame([], "symbol string, date date, returns double")
    assert factors.factor_residuals(none).collect() == []
    odd = spark.createDataFrame([("A", day, float("inf")), ("A", day + datetime.timedelta(1), float("nan")), ("B", day, None)], "symbol string, date date, returns double")
    assert [r["factor_residual"] for r in factors.factor_residuals(odd).collect()] == [None] * 3


def test_plan_has_no_column_per_symbol(spark):
    _, rows = panel_of(40, 30, 1, 3)
    entries = factors.centred(spark.createDataFrame(rows, "symbol string, date date, returns double"))
    v = entries.select("symbol").distinct().select("symbol", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert len(factors.multiplied(entries, v, 2).columns) == 2 and "S17" not in factors.multiplied(entries, v, 2)._jdf.queryExecution().toString()
