"""Labels, joins, scores, audits, metrics, ledgers, store and readers on hand-written rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from qpanel.functions import text
from qpanel.operators import events, joins, labels, ledger, metrics, scoring, validation
from qpanel.sources import bars as sources
from qpanel.sources import store
from qpanel.sources.bars import panel

D = dt.date(2024, 1, 1)
SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def day(k):
    return D + dt.timedelta(k)


def frame(spark, closes, highs=None, lows=None, symbol="A"):
    rows = [(symbol, day(k), c, (highs or closes)[k], (lows or closes)[k], c, 10.0) for k, c in enumerate(closes)]
    return panel(spark.createDataFrame(rows, SCHEMA), least=1)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "date").collect()]


@pytest.mark.parametrize(
    ("highs", "lows", "want"),
    [
        ([100, 106, 100], [100, 90, 100], 1),  # both in one bar: profit first
        ([100, 101, 106], [100, 96, 100], -1),
        ([100, 101, 102], [100, 99, 98], 0),  # end of data
        ([100, 104.999, 105.0], [100, 97.001, 99], 1),
    ],
)
def test_triple_barrier(spark, highs, lows, want):
    assert column(labels.triple_barrier(frame(spark, [100.0] * 3, [float(h) for h in highs], [float(x) for x in lows])), "triple_barrier")[0] == want


def test_forward_returns_and_meta_label(spark):
    df = labels.forward_returns(frame(spark, [100.0, 110.0, 99.0, 120.0]), (1, 3))
    assert column(df, "forward_return_1d") == [pytest.approx(0.1), pytest.approx(-0.1), pytest.approx(120 / 99 - 1), None]
    assert column(df, "forward_return_3d")[1:] == [None] * 3
    m = labels.meta_label(frame(spark, [100.0, 110.0, 99.0]).withColumn("s", F.col("i") == 1), "s")
    assert column(m, "meta_label") == [1, None, None] and column(m, "meta_status")[0] == "OK"
    assert column(labels.meta_label(frame(spark, [1.0, 2.0]).withColumn("s", F.lit(False)), "s"), "meta_status")[0] == "BLOCKED_NO_SIGNALS"


def test_ranks_need_five_symbols_and_ignore_missing(spark):
    rows = [(f"S{k}", D, float(k) if k < 6 else None) for k in range(7)] + [(f"S{k}", day(1), 1.0) for k in range(4)]
    df = labels.cross_sectional_ranks(spark.createDataFrame(rows, "symbol string, date date, forward_return_1d double"), (1,))
    got = {(r["symbol"], r["date"]): (r["forward_rank_1d"], r["top_decile_1d"], r["bottom_decile_1d"]) for r in df.collect()}
    assert got[("S5", D)] == (1.0, 1, 0) and got[("S0", D)] == (0.0, 0, 1) and got[("S6", D)] == (None, None, None) and got[("S0", day(1))] == (None, None, None)


def test_asof_and_known_at(spark):
    left = spark.createDataFrame([("A", day(0)), ("A", day(5)), ("B", day(5)), ("A", day(2))], "symbol string, t date")
    right = spark.createDataFrame([("A", day(1), 1.0), ("A", day(2), 2.0), ("A", day(9), 9.0)], "symbol string, at date, v double")
    got = {(r["symbol"], r["t"]): (r["asof_at"], r["v"]) for r in joins.asof(left, right, ["symbol"], "t", "at", ["v"]).collect()}
    assert got == {("A", day(0)): (None, None), ("A", day(2)): (day(2), 2.0), ("A", day(5)): (day(2), 2.0), ("B", day(5)): (None, None)}
    assert "Cartesian" not in joins.known_at(left, right, ["symbol"], "t", "at", ["v"])._jdf.queryExecution().executedPlan().toString()


def test_bars_after_and_event_windows(spark):
    p = frame(spark, [1.0, 2.0, 3.0, 4.0])
    s = spark.createDataFrame([(1, "A", day(1)), (2, "A", day(-3)), (3, "A", day(3)), (4, "Z", D)], "observation_id long, symbol string, signal_date date")
    got = sorted((r["observation_id"], r["after"], r["bar_close"]) for r in joins.bars_after(s, p, 2).collect())
    assert got == [(1, 1, 3.0), (1, 2, 4.0), (2, 1, 1.0), (2, 2, 2.0)]
    e = spark.createDataFrame([("A", day(2))], "symbol string, event_date date")
    assert column(joins.in_event_window(p, e, 1, 0), "in_window") == [False, True, True, False]


def test_snapshot_diff_and_first_match(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 2), (3, "z", 3)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", 5), (2, "y", 2), (4, "w", 4)], "k int, s string, n int")
    got = {(r["k"], r["field"]): (r["status"], r["old_value"], r["new_value"]) for r in joins.snapshot_diff(a, b, ["k"], ["s", "n"]).collect()}
    assert got[(1, "n")] == ("CHANGED", None, "5") and got[(3, "s")] == ("REMOVED", "z", None) and got[(4, "n")] == ("ADDED", None, "4") and (2, "n") not in got
    assert joins.snapshot_diff(a, a, ["k"], ["s", "n"]).count() == 0
    m = joins.first_match(a, spark.createDataFrame([(1, 9, "late"), (1, 3, "early")], "k int, o int, v string"), "k", "o", ["v"])
    assert {r["k"]: r["v"] for r in m.collect()} == {1: "early", 2: None, 3: None}


def test_scores_on_known_relations(spark):
    rows = [("A", day(k), "f", float(k % 50), "y", float(k % 50) * 2) for k in range(200)] + [("A", day(k), "g", 1.0, "y", float(k)) for k in range(200)] + [("A", day(k), "h", float(k), "y", float(k)) for k in range(49)]
    p = spark.createDataFrame(rows, "symbol string, date date, feature string, x double, label string, y double")
    ic = {r["feature"]: r for r in scoring.rank_ic(p).collect()}
    assert ic["f"]["rank_ic"] == pytest.approx(1) and ic["g"]["rank_ic"] is None and ic["h"]["rank_ic"] is None and ic["h"]["n_obs"] == 49
    mi = {r["feature"]: r["mutual_information"] for r in scoring.mutual_information(p).collect()}
    assert mi["f"] > 2.5 and mi["g"] == pytest.approx(0) and mi["h"] == 0
    spread = {r["feature"]: r["decile_spread"] for r in scoring.decile_spread(p).collect()}
    assert spread["f"] > 80 and spread["h"] == 0
    st = scoring.ic_stability(p.filter("feature = 'f'"), least=100).first()
    assert st["n_segments"] == 3 and st["ic_std"] == pytest.approx(0, abs=1e-9) and not st["unstable"]


def test_status_ladder(spark):
    rows = [(0.6, 0.5, 1.0, 1.0), (0.0, 0.001, 0.0, 0.0), (0.0, 0.015, 0.0, 0.0), (0.0, 0.03, 0.0, 0.0), (0.0, 0.005, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "m double, ic double, mi double, s double").select(scoring.status(F.col("m"), F.col("ic"), F.col("mi"), F.col("s")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["BLOCKED", "DEAD", "WEAK", "CANDIDATE", "WEAK"]


def test_purged_splits_known_sizes(spark):
    got = validation.verify_splits(validation.purged_splits(spark, 500)).orderBy("split").collect()
    assert [r["n_train"] for r in got] == [45, 128, 211, 294, 377] and [r["n_test"] for r in got] == [83] * 5
    assert not any(r["overlaps"] for r in got) and all(r["chronological"] for r in got)
    with pytest.raises(ValueError, match="too few"):
        validation.purged_splits(spark, 20)


def test_redundancy_and_theme(spark):
    rows = [(float(k), float(2 * k), float(-k), float(k % 3), None) for k in range(30)]
    df = spark.createDataFrame(rows, "a_x double, a_y double, b double, c double, d double")
    pairs = validation.correlation_pairs(df, ["a_x", "a_y", "b", "c", "d"])
    got = {(r["a"], r["b"]): r["r"] for r in pairs.collect()}
    assert got[("a_x", "a_y")] == pytest.approx(1) and got[("a_x", "b")] == pytest.approx(-1) and got[("a_x", "d")] == 0
    clusters = validation.redundancy_clusters(pairs, {"a_x": 1.0, "a_y": 4.0, "b": 1.0}, ["a_x", "a_y", "b", "c", "d"])
    assert clusters == [{"seed": "a_x", "members": ["a_x", "a_y", "b"], "representative": "a_y", "theme": "general"}]
    assert validation.theme(["sma_5", "sma_10"]) == "sma"


def test_subsets_language_and_multiple_testing(spark):
    b = spark.createDataFrame([("A", day(k)) for k in range(5)], "symbol string, date date")
    assert validation.subset_audit(b, b.limit(2)).first().asDict() == {"n_base": 5, "n_filtered": 2, "n_new": 0, "n_removed": 3, "n_repeated": 0, "verdict": "PURE_FILTER"}
    assert validation.subset_audit(b.limit(2), b).first()["verdict"] == "NOT_A_SUBSET"
    docs = spark.createDataFrame([(1, "A GUARANTEED win"), (2, "fine"), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in validation.forbidden_language(docs, ["guaranteed"]).collect()] == [(1, "guaranteed")]
    t = spark.createDataFrame([(k, p) for k, p in enumerate((0.001, 0.012, 0.014, 0.04, 0.6))], "k int, p_value double")
    got = {r["k"]: (r["bonferroni"], r["holm"], r["bhy"]) for r in validation.multiple_testing(t).collect()}
    assert got == {0: (True, True, True), 1: (False, True, False), 2: (False, True, False), 3: (False, False, False), 4: (False, False, False)}


def test_metrics_known_values(spark):
    e = spark.createDataFrame([("A", day(k), float(v)) for k, v in enumerate((100, 110, 105, 120, 90, 95))], "symbol string, date date, equity double")
    m = metrics.metric_pack(e, ["symbol"]).first()
    assert m["max_drawdown"] == pytest.approx(-0.25) and m["total_return"] == pytest.approx(-0.05) and m["time_under_water"] == pytest.approx(0.5)
    t = metrics.trade_metrics(spark.createDataFrame([("A", float(x)) for x in (10, -5, 20, -5)], "symbol string, pnl double"), ["symbol"]).first()
    assert (t["profit_factor"], t["expectancy"], t["trade_count"]) == (3.0, 5.0, 4)
    assert metrics.trade_metrics(spark.createDataFrame([("A", 1.0)], "symbol string, pnl double"), ["symbol"]).first()["profit_factor"] == float("inf")


def test_costs_known_value(spark):
    got = events.horizon_costs(spark.createDataFrame([(1, 186.5)], "horizon int, spread_bps double"), spark).filter("cost_bps = 10").first()
    assert got["annual_cost_bps"] == 2520 and got["adjusted_bps"] == pytest.approx(-2333.5) and got["survives"]


def test_scoreboard_rows(spark):
    p = frame(spark, [100.0, 101.0, 102.0, 103.0, 95.0, 104.0, 105.0], lows=[100.0, 100.0, 101.0, 102.0, 94.0, 103.0, 104.0])
    obs = spark.createDataFrame([(1, "A", day(4), 95.0, "PENDING", 0.2), (2, "A", day(0), 100.0, "PENDING", 0.0), (3, "Z", day(0), 10.0, "done", -0.1), (4, "A", day(1), 60.0, "done", 0.0)], "observation_id int, symbol string, signal_date date, signal_close double, outcome_status string, ret_5d double")
    got = {r["observation_id"]: r for r in ledger.scoreboard(obs, p).collect()}
    assert got[1]["maturity_status"] == "Still Maturing" and got[1]["bars_elapsed"] == 2 and got[1]["result_5_day"] is None and got[1]["main_view"] == ledger.PULLBACK
    assert got[2]["maturity_status"] == "Setup Broke" and got[2]["result_5_day"] == "+4.00%" and got[2]["current_price"] == 105.0
    assert got[3]["maturity_status"] == "Insufficient Data" and got[3]["main_view"] == ledger.WEAK
    assert got[4]["maturity_status"] == "5-Day Mature" and not got[4]["setup_broke"]


def test_cards_and_sections(spark):
    obs = spark.createDataFrame([(1, " spy ", 100.0, "pending", 0.0), (2, "QQQ", 100.0, "x", 0.2)], "observation_id int, symbol string, signal_close double, outcome_status string, ret_5d double")
    progress = spark.createDataFrame([("SPY", 3, 7)], "symbol string, future_bars int, bars_remaining int")
    got = {r["symbol"]: r for r in ledger.cards(obs, progress, "B+").collect()}
    assert got["SPY"]["progress"] == "3/10 bars recorded; 7 bars remaining." and got["SPY"]["score"] == "84" and got["SPY"]["setup_breaks_below"] == 96.0
    assert {(r["symbol"], r["section"]) for r in ledger.sections(ledger.card_view(obs)).collect()} == {(" spy ", "waiting"), ("QQQ", "bullish"), ("QQQ", "too_stretched")}
    assert [r["main_view"] for r in ledger.rejects(spark.createDataFrame([("a", "Archived"), ("b", "open")], "lineage string, status string")).collect()] == ["No Edge"]


def test_scalars(spark):
    df = spark.createDataFrame([(" Yes", "nan", "A", 0.01234), ("no", "x", "zz", -0.5)], "a string, b string, g string, r double")
    got = df.select(text.is_true_token(F.col("a")), text.is_empty_token(F.col("b")), text.grade_score(F.col("g")), text.signed_percent(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(True, True, "90", "+1.23%"), (False, False, "zz", "-50.00%")]
    days = {r["date"]: r["next_trading_day"] for r in text.calendar(spark, "2024-01-01", "2024-01-10", spark.createDataFrame([(dt.date(2024, 1, 1),)], "date date")).collect()}
    assert dt.date(2024, 1, 1) not in days and days[dt.date(2024, 1, 5)] == dt.date(2024, 1, 8)


def test_readers(spark, tmp_path):
    (tmp_path / "SPY.csv").write_text("timestamp,Open,High,Low,Close,Volume\n2024-01-02,1,2,,1.5,10\nbad,1,2,1,1,1\n2024-01-03,1,2,1,oops,1\n2024-01-04 00:00:00,1,2,0.5,1.25,7\n")
    b = sources.read_csv_bars(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r["symbol"], r["low"], r["close"]) for r in b] == [("SPY", 1.5, 1.5), ("SPY", 0.5, 1.25)]
    rows = [(" spy ", D, 1.0, 2.0, 1.0, 1.5, 1.0, 1), ("SPY", D, 1.0, 2.0, 1.0, 1.6, 1.0, 2), ("SPY", day(1), 1.0, 0.5, 1.0, 1.5, -1.0, 3)]
    raw = spark.createDataFrame(rows, SCHEMA + ", ingest_order int")
    n = sources.normalise(raw)
    assert n.filter(F.col("date") == F.lit(D)).first()["close"] == 1.6 and n.count() == 2
    assert sources.validate(n).first().asDict() == {"n_bars": 2, "bad_ohlc": 1, "negative_volume": 1, "missing": 0}
    good, bad = sources.quarantine(n)
    assert good.count() == 1 and bad.count() == 1
    assert store.read_ledger(spark, str(tmp_path / "none"), "a string").count() == 0
    (tmp_path / "l.csv").write_text("a,b\nx,1\ny,oops\n")
    assert [r["_corrupt_record"] for r in store.read_ledger(spark, str(tmp_path / "l.csv"), "a string, b int").collect()] == [None, "y,oops"]


def test_feature_store(spark, tmp_path):
    s = store.FeatureStore(spark, str(tmp_path / "store"))
    assert s.read().count() == 0 and s.versions().count() == 0
    wide = spark.createDataFrame([("A", day(k), float(k), None if k == 3 else 2.0 * k) for k in range(4)] + [("B", D, 9.0, 9.0)], "symbol string, date date, f double, g double")
    s.write(wide, {"f": "technical", "g": "regime"}, "v1")
    s.write(wide.withColumn("f", F.col("f") + 1), {"f": "technical", "g": "regime"}, "v2")
    s.write(wide, {"f": "technical", "g": "regime"}, "v1b")
    assert {r["version"] for r in s.versions().collect()} == {"v1", "v2", "v1b"} and s.latest() == "v1b"
    assert joins.snapshot_diff(wide, s.matrix(["f", "g"], version="v1"), ["symbol", "date"], ["f", "g"]).count() == 0
    assert {r["feature"]: r["value"] for r in s.at("A", str(day(3)), version="v1").collect()} == {"f": 3.0, "g": 4.0}
    assert s.read(version="unknown").count() == 0 and s.read(["B"], "v2", ["f"]).first()["value"] == 10.0
    c = s.catalog(["g"], fqn="v1/A/regime/g").first()
    assert (c["n_values"], c["n_nan"]) == (4, 1)
    assert {r["category"]: r["n_features"] for r in s.summary("v1").collect()} == {"technical": 1, "regime": 1}
    store.write_report(wide, str(tmp_path / "r"), "run1")
    store.write_report(wide, str(tmp_path / "r"), "run1")
    assert spark.read.json(str(tmp_path / "r")).count() == 5


def test_missing_sessions_are_weekdays(spark):
    import datetime as dt

    from qpanel.sources import bars as b

    start = dt.date(1969, 12, 29)
    days = [start + dt.timedelta(k) for k in (0, 1, 4, 5, 9, 9, 40, 41)]
    rows = [("A", d, 1.0, 1.0, 1.0, 1.0, 10) for d in days] + [("B", dt.date(2024, 6, 1), 1.0, 1.0, 1.0, 1.0, 10)]
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume long")
    got = {r["symbol"]: r for r in b.quality_profile(df).collect()}
    sessions = [d for k in range(42) if (d := start + dt.timedelta(k)).weekday() < 5]
    assert got["A"]["missing_days"] == len(set(sessions) - set(days)) and got["A"]["out_of_session"] == sum(d.weekday() > 4 for d in days)
    assert got["B"]["missing_days"] == 0 and got["B"]["out_of_session"] == 1 and got["B"]["score"] == 100


def test_null_baseline_reads_its_rows_once_and_multiplies_one_side(spark, tmp_path):
    rows = [(s, day(k), float((k * 7 + len(s)) % 11), float((k * 5) % 13)) for s in ("A", "BB") for k in range(40)]
    spark.createDataFrame(rows, "symbol string, date date, x double, y double").write.parquet(f"{tmp_path}/rows")
    df = validation.null_baselines(spark.read.parquet(f"{tmp_path}/rows"), "x", ["y"], perms=3)
    # what the input takes, as the broadcast of parts, is there once, not once for each branch
    assert not [f for f in df.inputFiles() if "/rows/" in f]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 2 and "BroadcastExchange" not in plan
    assert {(r["baseline"], r["n"]) for r in df.collect()} == {("shuffled_label", 6), ("random_feature", 6)}
