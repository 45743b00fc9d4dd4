"""Features on small frames: warm-up, missing values, flat prices, no look-ahead, partition invariance."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from qpanel.operators import catalogue, spec
from qpanel.plans import features as fq
from qpanel.sources.bars import panel

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def bars(spark, n=300, symbols=("A", "B"), seed=1, flat=False):
    rng, rows = random.Random(seed), []
    for s in symbols:
        p = 50.0
        for k in range(n):
            p = p if flat else p * (1 + rng.gauss(0, 0.02))
            o = p if flat else p * (1 + rng.gauss(0, 0.005))
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(k), o, max(o, p) * (1 if flat else 1.01), min(o, p) * (1 if flat else 0.99), p, 100.0 if flat else float(rng.randint(50, 150))))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def computed(spark):
    from qpanel.operators.residual import with_own_benchmark

    df = with_own_benchmark(panel(bars(spark, symbols=("S1", "S2", "S6"))))
    return spec.compute(df, fq.every_spec(), fq.feature_names()).orderBy("symbol", "date").toPandas()


def test_there_are_117_features(spark):
    names = fq.feature_names()
    assert len(names) == len(set(names)) == 117
    count = {}
    for s in fq.every_spec():
        if not s.name.startswith("_"):
            count[s.category] = count.get(s.category, 0) + 1
    assert count == {"technical": 51, "statistical": 32, "regime": 10, "residual": 7, "microstructure": 17}


def test_first_valid_bar_is_the_registered_lookback(spark, computed):
    one = computed[computed.symbol == "S1"].reset_index(drop=True)
    for s in fq.every_spec():
        if s.name.startswith("_"):
            continue
        first = one[s.name].first_valid_index()
        if s.name in ("regime_score", "adx_proxy_14"):
            assert first is not None and first + 1 >= s.lookback - 1, s.name
        elif s.name in ("downward_pressure", "consec_up", "consec_down", "macd_signal", "macd_histogram", "breadth_sma20", "daily_gap", "up_down_vol_ratio", "hh_ll_20d", "rsi_2", "rsi_7", "rsi_14"):
            assert first is not None and first <= s.lookback, s.name
        else:
            assert first == s.lookback - 1, (s.name, first, s.lookback)


def test_missing_counts_as_zero_in_means(spark):
    rows = [("A", dt.date(2020, 1, k), 1.0, 1.0, 1.0, None if k == 3 else float(k), 1.0) for k in range(1, 8)]
    df = panel(spark.createDataFrame(rows, SCHEMA), least=1)
    got = [r["sma_5"] for r in spec.compute(df, fq.every_spec(), ["sma_5"]).orderBy("date").collect()]
    assert got[:4] == [None] * 4 and got[4] == pytest.approx((1 + 2 + 0 + 4 + 5) / 5) and got[6] == pytest.approx((0 + 4 + 5 + 6 + 7) / 5)


def test_flat_prices_and_zero_volume(spark):
    df = panel(bars(spark, 80, ("F",), flat=True).withColumn("volume", F.lit(0.0)))
    r = spec.compute(df, fq.every_spec(), ["zscore_20d", "skew_20d", "pv_corr_20d", "eff_ratio_10d", "bb_position", "amihud_illiquidity", "rvol_20", "vwap_proxy", "close_location", "consec_up"]).orderBy(F.desc("date")).first()
    assert all(r[c] is None for c in ("zscore_20d", "skew_20d", "pv_corr_20d", "eff_ratio_10d", "bb_position", "amihud_illiquidity", "rvol_20", "vwap_proxy", "close_location")) and r["consec_up"] == 0


def test_few_bars_leave_the_panel_and_nan_becomes_null(spark):
    df = bars(spark, 70, ("A",)).unionByName(bars(spark, 59, ("B",))).withColumn("volume", F.when(F.dayofmonth("date") == 3, float("nan")).otherwise(F.col("volume")))
    p = panel(df)
    assert {r[0] for r in p.select("symbol").distinct().collect()} == {"A"} and p.filter("isnan(volume)").count() == 0 and p.filter("volume IS NULL").count() > 0
    first = p.orderBy("date").first()
    assert first["returns"] == 0 and first["log_returns"] == 0 and first["i"] == 1


NAMES = ["sma_20", "ema_10", "rsi_14", "zscore_20d", "kurtosis_20d", "consec_up", "adx_proxy_14", "kyles_lambda", "hh_ll_20d", "macd_signal"]


def test_the_future_changes_nothing(spark):
    b = bars(spark, 200)
    whole = spec.compute(panel(b), fq.every_spec(), NAMES).filter("i <= 150")
    cut = spec.compute(panel(b.filter(F.col("date") < F.lit(dt.date(2020, 1, 1) + dt.timedelta(150)))), fq.every_spec(), NAMES)
    key = lambda df: [tuple(r) for r in df.select("symbol", "date", *NAMES).orderBy("symbol", "date").collect()]
    for x, y in zip(key(whole), key(cut), strict=True):
        assert x == pytest.approx(y, nan_ok=True)


def test_partitions_and_row_order_change_nothing(spark):
    b = bars(spark, 120)
    a = spec.compute(panel(b), fq.every_spec(), NAMES).select("symbol", "date", *NAMES)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        c = spec.compute(panel(b.orderBy(F.rand(3)).repartition(7)), fq.every_spec(), NAMES).select("symbol", "date", *NAMES)
        assert sorted(map(tuple, c.collect()), key=str) == sorted(map(tuple, a.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_exchange_for_all_windows(spark):
    plan = spec.compute(panel(bars(spark, 80)), fq.every_spec(), ["sma_20", "sma_20_slope", "zscore_50d", "vol_expansion", "donchian_pos_20", "ofi_5d"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(symbol") == 1


def test_catalogue(spark):
    df = spec.compute(panel(bars(spark, 120)), [*fq.every_spec(), *catalogue.specs()], [s.name for s in catalogue.specs() if not s.name.startswith("_")])
    last = df.orderBy(F.desc("date")).first().asDict()
    assert 0 <= last["stoch_k_14"] <= 100 and -100 <= last["williams_r_14"] <= 0 and 0 <= last["mfi_14"] <= 100 and -1 <= last["cmf_20"] <= 1
    assert last["stoch_k_14"] - 100 == pytest.approx(last["williams_r_14"])
