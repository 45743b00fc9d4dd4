"""Registered queries against the SQL that states their results, on the smallest tables; streams against batch."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from qpanel.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: All SQL texts take a quarter of an hour; without TEST_ALL_SQL those of each family run.
SAMPLE = [
    "w1_w6_moving_averages", "w20_w28_scores_drawdown", "w25_runs", "w49_w60_microstructure", "w9_w11_rsi_atr", "w13_macd", "w71_breadth_lines", "l1_l2_forward_returns", "l5_triple_barrier", "l6_l7_cross_sectional_ranks", "j4_asof_join", "j6_event_windows",
    "j12_snapshot_diff", "a3_a4_rank_ic", "a5_mutual_information", "a19_event_study", "a23_segments", "a31_classification_pack", "a31_concentration_index", "v5_v6_purged_cv", "v6_multi_horizon_cv", "v9_random_pruning", "v11_decile_polarity", "v12_duplicate_results", "v14_event_flags", "v19_forbidden_language", "v21_rejected_log", "v23_walk_forward", "b3_b6_j8_scoreboard", "s18_feature_cache", "v1_planted_leaks", "j14_venue_quotes", "w72_fundamentals", "w40_expanding_percentile", "l10_first_passage", "v20_hit_rates", "a36_correlation_regimes", "s11_mergeable_summaries", "t7_features_in_disorder",
    "s4_bars", "s7_quality_profile", "s13_point_in_time", "s14_s15_feature_matrix", "p12_p15_p16_scalars", "t1_t3_live_bars", "t2_late_events", "t4_sliding_volume", "t6_stale_alarms", "t7_running_features", "t9_stream_stream_join",
]
NAMES = sorted(catalog.oracle_sql()) if os.environ.get("TEST_ALL_SQL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "null" if v is None else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["bucket", "n", "mean_return", "hit_rate"] and e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    r = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(shown(row[names.index(c)]) for c in columns) for row in r.fetchall())


@pytest.mark.skipif(not os.environ.get("TEST_ALL_SQL"), reason="only with all SQL texts")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
