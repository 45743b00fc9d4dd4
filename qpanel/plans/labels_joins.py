"""Registered queries of labels (L1-L10) and joins (J2-J17), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel.functions.windows import fixed, lag
from qpanel.functions.windows import mean0 as rolling_mean
from qpanel.operators import joins, labels, residual
from qpanel.operators.spec import compute
from qpanel.sources.bars import table

from .features import every_spec, sample
from .sql import BARS, BENCH, W, mean0
from .sql import fixed as fx

H = labels.HORIZONS
QUERIES, SQL = {}, {}

OBSERVED = """obs AS (
  SELECT o_orderkey AS observation_id, 'Brand#' || CAST(1 + o_custkey % 5 AS VARCHAR) || CAST(1 + o_orderkey % 5 AS VARCHAR) AS symbol,
         CAST(o_orderdate AS DATE) AS signal_date, o_totalprice AS amount, o_orderstatus AS status FROM orders
)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations of a brand."""
    o = table(spark, sf_dir, "orders")
    symbol = F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 5).cast("string"), (1 + F.col("o_orderkey") % 5).cast("string"))
    return o.select(F.col("o_orderkey").alias("observation_id"), symbol.alias("symbol"), F.to_date("o_orderdate").alias("signal_date"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


fwd = {h: f"CASE WHEN close > 0 THEN lead(close, {h}) OVER w / close - 1 END" for h in H}


@query("l1_l2_forward_returns", f"WITH {BARS} SELECT symbol, date, " + ", ".join(f"{fwd[h]} AS forward_return_{h}d, {fx(f'CASE WHEN close > 0 AND lead(close, {h}) OVER w > 0 THEN ln(lead(close, {h}) OVER w / close) END', 9)} AS log_forward_return_{h}d" for h in H) + f" FROM panel {W}")
def forward(spark, sf_dir):
    df = labels.forward_returns(sample(spark, sf_dir))
    return df.select("symbol", "date", *[F.col(f"forward_return_{h}d") for h in H], *[fixed(f"log_forward_return_{h}d", 9).alias(f"log_forward_return_{h}d") for h in H])


LEVELS = f"""{BENCH}, market_level AS (SELECT date, avg(close) AS level FROM panel GROUP BY date
), sector_level AS (SELECT sector, date, avg(close) AS level FROM panel JOIN sectors USING (symbol) GROUP BY sector, date
), market_ahead AS (SELECT date, {', '.join(f'lead(level, {h}) OVER (ORDER BY date) / level - 1 AS m{h}' for h in H)} FROM market_level
), sector_ahead AS (SELECT sector, date, {', '.join(f'lead(level, {h}) OVER (PARTITION BY sector ORDER BY date) / level - 1 AS s{h}' for h in H)} FROM sector_level
)"""


@query("l3_l4_j2_excess_returns", f"WITH {BARS}, {LEVELS}, f AS (SELECT symbol, date, {', '.join(f'{fwd[h]} AS f{h}' for h in H)} FROM panel {W}) SELECT symbol, date, " + ", ".join(f"{fx(f'f{h} - m{h}')} AS excess_vs_spy_{h}d, {fx(f'f{h} - s{h}')} AS excess_vs_sector_{h}d" for h in H) + " FROM f JOIN sectors USING (symbol) LEFT JOIN market_ahead USING (date) LEFT JOIN sector_ahead USING (sector, date)")
def excess(spark, sf_dir):
    p = sample(spark, sf_dir)
    market = p.groupBy("date").agg(F.avg("close").alias("level"))
    sector = p.groupBy(residual.sector_of(F.col("symbol")).alias("sector"), "date").agg(F.avg("close").alias("level"))
    df = labels.forward_returns(p).withColumn("sector", residual.sector_of(F.col("symbol")))
    df = labels.excess_returns(df, market, ["date"], "level", "spy")
    df = labels.excess_returns(df, sector, ["sector", "date"], "level", "sector")
    return df.select("symbol", "date", *[fixed(f"excess_vs_{n}_{h}d").alias(f"excess_vs_{n}_{h}d") for h in H for n in ("spy", "sector")])


TOUCH = """touch AS (
  SELECT p.symbol, p.i, min(CASE WHEN q.high >= p.close * 1.05::DOUBLE THEN q.i END) AS up, min(CASE WHEN q.low <= p.close * (1 - 0.03::DOUBLE) THEN q.i END) AS down
  FROM panel p JOIN panel q ON p.symbol = q.symbol AND q.i BETWEEN p.i + 1 AND p.i + 10 GROUP BY p.symbol, p.i
), barrier AS (
  SELECT panel.*, CASE WHEN close <= 0 THEN NULL WHEN up IS NOT NULL AND (down IS NULL OR up <= down) THEN 1 WHEN down IS NOT NULL THEN -1 ELSE 0 END AS triple_barrier
  FROM panel LEFT JOIN touch USING (symbol, i)
)"""
RUNS = f"runs AS (SELECT *, sum(CASE WHEN i > 1 AND returns < 0 THEN 0 ELSE 1 END) OVER w AS gd FROM barrier {W}), down_runs AS (SELECT *, row_number() OVER (PARTITION BY symbol, gd ORDER BY date) - 1 AS consec_down FROM runs)"


@query("l5_triple_barrier", f"WITH {BARS}, {TOUCH} SELECT symbol, date, triple_barrier FROM barrier")
def barrier(spark, sf_dir):
    return labels.triple_barrier(sample(spark, sf_dir)).select("symbol", "date", "triple_barrier")


@query("l8_meta_label", f"WITH {BARS}, {TOUCH}, {RUNS} SELECT symbol, date, CASE WHEN consec_down = 3 THEN CASE WHEN triple_barrier = 1 THEN 1 ELSE 0 END END AS meta_label, 'OK' AS meta_status FROM down_runs")
def meta(spark, sf_dir):
    df = compute(sample(spark, sf_dir), every_spec(), ["consec_down"]).withColumn("signal", F.col("consec_down") == 3)
    return labels.meta_label(df, "signal").select("symbol", "date", "meta_label", "meta_status")


@query("l6_l7_cross_sectional_ranks", f"WITH {BARS}, f AS (SELECT symbol, date, {', '.join(f'{fwd[h]} AS f{h}' for h in H)} FROM panel {W}), g AS (SELECT symbol, date, " + ", ".join(f"CASE WHEN f{h} IS NOT NULL AND count(*) OVER (PARTITION BY date, f{h} IS NOT NULL) >= 5 THEN percent_rank() OVER (PARTITION BY date, f{h} IS NOT NULL ORDER BY f{h}) END AS forward_rank_{h}d" for h in H) + ") SELECT *, ".replace(")", " FROM f)", 1) + ", ".join(f"(forward_rank_{h}d >= 0.9)::INT AS top_decile_{h}d, (forward_rank_{h}d <= 0.1)::INT AS bottom_decile_{h}d" for h in H) + " FROM g")
def ranks(spark, sf_dir):
    df = labels.cross_sectional_ranks(labels.forward_returns(sample(spark, sf_dir)))
    return df.select("symbol", "date", *[f"{n}_{h}d" for h in H for n in ("forward_rank", "top_decile", "bottom_decile")])


@query("l9_label_validation", f"WITH {BARS}, f AS (SELECT {', '.join(f'{fwd[h]} AS forward_return_{h}d' for h in H)} FROM panel {W}), u AS (UNPIVOT (SELECT {', '.join(f'coalesce(forward_return_{h}d, -9e9) AS forward_return_{h}d' for h in H)} FROM f) ON * INTO NAME label VALUE v) SELECT label, count(*) AS n, count(*) FILTER (v = -9e9) AS n_nan, 0::BIGINT AS n_inf, count(*) FILTER (v = -9e9) / count(*) AS nan_rate, count(*) FILTER (v = -9e9) / count(*) < 0.3 AS passed FROM u GROUP BY label")
def validation(spark, sf_dir):
    return labels.validate(labels.forward_returns(sample(spark, sf_dir)), [f"forward_return_{h}d" for h in H])


@query("l10_path_excursion", f"WITH {BARS}, m AS (SELECT symbol, close, i, count(*) OVER n AS k, min(low) OVER n AS lo, max(high) OVER n AS hi FROM panel WINDOW n AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)), t AS (SELECT m.*, lo / close - 1 AS mae, hi / close - 1 AS mfe, (SELECT min(q.i) FROM panel q WHERE q.symbol = m.symbol AND q.i BETWEEN m.i + 1 AND m.i + 10 AND q.high = m.hi) - m.i AS tt FROM m WHERE k = 10) SELECT symbol, count(*) AS n, {fx('avg(mae)')} AS mean_mae, {fx('quantile_cont(mae, 0.5)')} AS median_mae, {fx('avg(mfe)')} AS mean_mfe, {fx('quantile_cont(mfe, 0.5)')} AS median_mfe, {fx('avg(tt)')} AS mean_time_to_mfe, {fx('avg((mae <= -0.03)::INT)')} AS stop_hit_rate, {fx('abs(avg(mae)) / avg(mfe)')} AS mae_mfe_ratio FROM t GROUP BY symbol")
def excursion(spark, sf_dir):
    df = labels.excursion_report(labels.path_excursion(sample(spark, sf_dir)))
    return df.select("symbol", "n", *[fixed(c).alias(c) for c in df.columns[2:]])


TR_SQL = "CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END"


@query("l10_first_passage", f"""WITH {BARS}, tr AS (SELECT *, {TR_SQL} AS tr FROM panel {W}), lv AS (SELECT symbol, date, i, close - 2 * atr AS stop, close + 3 * atr AS target FROM (SELECT *, {mean0('tr', 14)} AS atr FROM tr {W}) WHERE atr IS NOT NULL
  ), last_ AS (SELECT symbol, max(i) AS n FROM panel GROUP BY symbol
  ), hits AS (SELECT l.symbol, l.i, min(q.i - l.i) FILTER (q.low <= stop) AS s, min(q.i - l.i) FILTER (q.high >= target) AS p FROM lv l LEFT JOIN panel q ON q.symbol = l.symbol AND q.i BETWEEN l.i + 1 AND l.i + 45 GROUP BY l.symbol, l.i
  ), h AS (SELECT *, CASE WHEN s <= coalesce(p, s) THEN 'stop' WHEN p IS NOT NULL THEN 'profit' WHEN n - i >= 45 THEN 'none' END AS hit FROM hits JOIN last_ USING (symbol))
  SELECT symbol, count(*) AS n, {fx("avg((hit = 'stop')::INT)")} AS stop_hit_rate, {fx("avg((hit = 'profit')::INT)")} AS profit_rate, {fx("avg(p) FILTER (hit = 'profit')")} AS mean_bars_to_profit, {fx("quantile_cont(p, 0.5) FILTER (hit = 'profit')")} AS median_bars_to_profit FROM h WHERE hit IS NOT NULL GROUP BY symbol""")
def passages(spark, sf_dir):
    """Stops two, and targets three average true ranges away from each close, over 45 bars."""
    p = sample(spark, sf_dir)
    before = lag("close")
    tr = F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    p = p.withColumn("tr", tr).withColumn("atr", rolling_mean("tr", 14))
    df = labels.passage_report(labels.first_passages(p, F.col("close") - 2 * F.col("atr"), F.col("close") + 3 * F.col("atr"), 45))
    return df.select("symbol", "n", *[fixed(c).alias(c) for c in df.columns[2:]])


@query("j3_bars_after_signal", f"WITH {BARS}, {OBSERVED}, o AS (SELECT obs.*, coalesce(max(panel.i), 0) AS own FROM obs LEFT JOIN panel ON panel.symbol = obs.symbol AND panel.date <= obs.signal_date GROUP BY ALL) SELECT observation_id, o.symbol, panel.date AS bar_date, panel.close AS bar_close, CAST(panel.i - own AS INT) AS after FROM o JOIN panel ON panel.symbol = o.symbol AND panel.i BETWEEN own + 1 AND own + 5")
def after_signal(spark, sf_dir):
    return joins.bars_after(observations(spark, sf_dir), sample(spark, sf_dir), 5).select("observation_id", "symbol", "bar_date", "bar_close", "after")


@query("j4_asof_join", f"WITH {BARS}, {OBSERVED} SELECT obs.observation_id, obs.symbol, obs.signal_date, panel.date AS asof_date, panel.close, panel.i FROM obs ASOF LEFT JOIN panel ON obs.symbol = panel.symbol AND obs.signal_date >= panel.date")
def as_of(spark, sf_dir):
    return joins.asof(observations(spark, sf_dir), sample(spark, sf_dir), ["symbol"], "signal_date", "date", ["close", "i"]).select("observation_id", "symbol", "signal_date", "asof_date", "close", "i")


@query("j5_known_at_join", f"WITH {BARS}, {OBSERVED}, facts AS (SELECT symbol, last_day(date) + 5 AS known, last_day(date) AS period_end, sum(volume) AS month_volume FROM panel GROUP BY symbol, last_day(date)) SELECT obs.observation_id, obs.symbol, f.known AS asof_known, f.period_end, f.month_volume FROM obs ASOF LEFT JOIN facts f ON obs.symbol = f.symbol AND obs.signal_date >= f.known")
def knowledge(spark, sf_dir):
    end = F.last_day("date")
    facts = sample(spark, sf_dir).groupBy("symbol", end.alias("period_end")).agg(F.sum("volume").alias("month_volume")).withColumn("known", F.date_add("period_end", 5))
    return joins.known_at(observations(spark, sf_dir), facts, ["symbol"], "signal_date", "known", ["period_end", "month_volume"]).select("observation_id", "symbol", "asof_known", "period_end", "month_volume")


@query("j6_event_windows", f"WITH {BARS}, {OBSERVED}, e AS (SELECT DISTINCT symbol, signal_date FROM obs WHERE amount > 400000) SELECT symbol, date, EXISTS (SELECT 1 FROM e WHERE e.symbol = panel.symbol AND panel.date BETWEEN e.signal_date - 5 AND e.signal_date + 2) AS in_window FROM panel")
def windows(spark, sf_dir):
    events = observations(spark, sf_dir).filter("amount > 400000").withColumnRenamed("signal_date", "event_date")
    return joins.in_event_window(sample(spark, sf_dir), events, 5, 2).select("symbol", "date", "in_window")


@query("j7_first_match", "SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) ON c_custkey = o_custkey AND n = 1")
def first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.first_match(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), o, "c_custkey", "o_orderdate", ["o_orderkey", "o_totalprice"])


@query("j9_semi_anti", f"WITH {BARS}, {OBSERVED} SELECT symbol, count(*) AS n_bars, count(*) FILTER (EXISTS (SELECT 1 FROM obs WHERE obs.symbol = panel.symbol AND obs.signal_date = panel.date)) AS n_observed, count(*) FILTER (NOT EXISTS (SELECT 1 FROM obs WHERE obs.symbol = panel.symbol AND obs.signal_date = panel.date)) AS n_unobserved FROM panel GROUP BY symbol")
def semi_anti(spark, sf_dir):
    p, o = sample(spark, sf_dir), observations(spark, sf_dir).select("symbol", F.col("signal_date").alias("date"))
    seen = p.join(o, ["symbol", "date"], "left_semi").select("symbol", F.lit(1).alias("seen"))
    unseen = p.join(o, ["symbol", "date"], "left_anti").select("symbol", F.lit(0).alias("seen"))
    df = seen.unionByName(unseen).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("seen").alias("n_observed"))
    return df.withColumn("n_unobserved", F.col("n_bars") - F.col("n_observed"))


SNAP = "SELECT symbol, CAST(count(*) AS VARCHAR) AS n_bars, CAST(max(date) AS VARCHAR) AS last_date FROM panel {} GROUP BY symbol"


@query("j12_snapshot_diff", f"WITH {BARS}, a AS ({SNAP.format(chr(39).join(['WHERE date < DATE ', '1997-06-01', '']))}), b AS ({SNAP.format(chr(39).join(['WHERE date < DATE ', '1998-06-01', '']))}), j AS (SELECT symbol, a.n_bars AS a1, b.n_bars AS b1, a.last_date AS a2, b.last_date AS b2 FROM a FULL JOIN b USING (symbol)) SELECT symbol, CASE WHEN b1 IS NULL THEN 'REMOVED' WHEN a1 IS NULL THEN 'ADDED' ELSE 'CHANGED' END AS status, field, old_value, new_value FROM (SELECT symbol, a1, b1, 'n_bars' AS field, a1 AS old_value, b1 AS new_value FROM j UNION ALL SELECT symbol, a1, b1, 'last_date', a2, b2 FROM j) WHERE old_value IS DISTINCT FROM new_value")
def diff(spark, sf_dir):
    p = sample(spark, sf_dir)
    snap = lambda d: p.filter(F.col("date") < F.to_date(F.lit(d))).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.max("date").alias("last_date"))
    return joins.snapshot_diff(snap("1997-06-01"), snap("1998-06-01"), ["symbol"], ["n_bars", "last_date"])


PAIRS = "pairs AS (SELECT a.symbol AS a, b.symbol AS b FROM sectors a JOIN sectors b ON a.sector = b.sector AND a.symbol < b.symbol)"
PW = "(PARTITION BY a, b ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query("j13_pairs_spread", f"WITH {BARS}, {BENCH}, {PAIRS}, j AS (SELECT a, b, p.date, ln(p.close) AS ya, ln(q.close) AS yb FROM pairs JOIN panel p ON p.symbol = a JOIN panel q ON q.symbol = b AND q.date = p.date), h AS (SELECT *, CASE WHEN count(*) OVER {PW} >= 60 AND var_pop(yb) OVER {PW} > 0 THEN covar_pop(ya, yb) OVER {PW} / var_pop(yb) OVER {PW} END AS hedge_ratio FROM j), s AS (SELECT *, ya - hedge_ratio * yb AS spread FROM h), z AS (SELECT *, CASE WHEN count(spread) OVER {PW} >= 60 AND stddev_pop(spread) OVER {PW} <> 0 THEN (spread - avg(spread) OVER {PW}) / stddev_pop(spread) OVER {PW} END AS spread_z FROM s) SELECT a, b, date, {fx('hedge_ratio', 5)} AS hedge_ratio, {fx('spread', 5)} AS spread, {fx('spread_z', 4)} AS spread_z FROM z")
def spreads(spark, sf_dir):
    p = sample(spark, sf_dir)
    s = p.select("symbol").distinct().withColumn("sector", residual.sector_of(F.col("symbol")))
    pairs = s.select("sector", F.col("symbol").alias("a")).join(s.select("sector", F.col("symbol").alias("b")), "sector").filter("a < b").select("a", "b")
    return joins.pair_spread(p, pairs).select("a", "b", "date", fixed("hedge_ratio", 5).alias("hedge_ratio"), fixed("spread", 5).alias("spread"), fixed("spread_z", 4).alias("spread_z"))


@query("j14_cross_venue", f"WITH q AS (SELECT o_orderstatus AS symbol, o_orderpriority AS venue, CAST(o_orderdate AS DATE) AS ts, o_totalprice AS price FROM orders), g AS (SELECT symbol, ts, arg_max(venue, (price, venue)) AS sell_venue, max(price) AS sell_price, arg_min(venue, (price, venue)) AS buy_venue, min(price) AS buy_price FROM q GROUP BY symbol, ts) SELECT *, {fx('sell_price * (1 - 0.001::DOUBLE) / (buy_price * (1 + 0.001::DOUBLE)) - 1')} AS net_spread FROM g WHERE sell_venue <> buy_venue")
def venues(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderpriority").alias("venue"), F.to_date("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    return joins.cross_venue(q).withColumn("net_spread", fixed("net_spread"))


VENUES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Quotes of orders at times of their own: no two are at one time.
QUOTES_SQL = "quotes AS (SELECT o_orderstatus AS symbol, o_orderpriority AS venue, o_orderdate + to_seconds(o_orderkey % 86400) + to_microseconds(CAST(o_orderkey AS BIGINT)) AS ts, o_totalprice AS bid, o_totalprice * (1.001::DOUBLE + 0.001::DOUBLE * (o_custkey % 4)) AS ask FROM orders)"


@query("j14_venue_quotes", f"""WITH {QUOTES_SQL}, v AS (SELECT DISTINCT venue FROM quotes), g AS (SELECT q.symbol, q.ts, v.venue FROM quotes q CROSS JOIN v), l AS (
    SELECT g.symbol, g.ts, g.venue, q.bid, q.ask FROM g ASOF JOIN quotes q ON g.symbol = q.symbol AND g.venue = q.venue AND g.ts >= q.ts WHERE q.ts >= g.ts - INTERVAL 6 HOUR
  ), p AS (SELECT s.symbol, s.ts, s.bid, b.ask, s.venue AS sell_venue, b.venue AS buy_venue, s.bid * (1 - 0.001::DOUBLE) / (b.ask * (1 + 0.001::DOUBLE)) - 1 AS net FROM l s JOIN l b ON s.symbol = b.symbol AND s.ts = b.ts AND s.venue <> b.venue
  ), x AS (SELECT symbol, ts, arg_max({{'bid': bid, 'ask': ask, 'sell': sell_venue, 'buy': buy_venue, 'net': net}}, (net, sell_venue, buy_venue)) AS best FROM p GROUP BY symbol, ts)
  SELECT symbol, ts, best.bid AS bid, best.ask AS ask, best.sell AS sell_venue, best.buy AS buy_venue, {fx('best.net')} AS net_spread FROM x""")
def venue_quotes(spark, sf_dir):
    """Venues that quote at times of their own, with bid and ask."""
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400) + F.make_dt_interval(secs=(F.col("o_orderkey") / 1e6).cast("decimal(18,6)"))
    ask = F.col("o_totalprice") * (F.lit(1.001) + F.lit(0.001) * (F.col("o_custkey") % 4))
    q = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderpriority").alias("venue"), at.alias("ts"), F.col("o_totalprice").alias("bid"), ask.alias("ask"))
    return joins.venue_spread(q, VENUES, stale="6 hours").withColumn("net_spread", fixed("net_spread"))


@query("j15_basket_premium", f"WITH {BARS}, {BENCH}, n AS (SELECT sector AS fund, date, sum(1.0::DOUBLE * close) AS basket_value, count(*) AS n_held, sum(open) AS price FROM panel JOIN sectors USING (symbol) GROUP BY sector, date) SELECT fund, date, n_held, {fx('price / basket_value - 1')} AS premium FROM n")
def premium(spark, sf_dir):
    p = sample(spark, sf_dir).withColumn("fund", residual.sector_of(F.col("symbol")))
    held = p.select("fund", "symbol").distinct().withColumn("shares", F.lit(1.0))
    df = joins.basket_premium(held, p.select("symbol", "date", "close"), p.groupBy("fund", "date").agg(F.sum("open").alias("price")))
    return df.select("fund", "date", "n_held", fixed("premium").alias("premium"))


@query("j16_basis_carry", f"WITH {BARS}, f AS (SELECT symbol AS underlying, date, close AS spot_price, open AS future_price, last_day(date) + 60 AS expiry FROM panel), y AS (SELECT *, date_diff('day', date, expiry) / 365.0::DOUBLE AS years FROM f WHERE close_ok(spot_price, future_price)) SELECT underlying, date, {fx('future_price / spot_price - 1')} AS basis, {fx('exp(0.03::DOUBLE * years) - 1')} AS fair_basis, {fx('ln(future_price / spot_price) / years')} AS annual_carry, {fx('ln(future_price / spot_price) / years - 0.03::DOUBLE')} AS mispricing FROM y".replace("close_ok(spot_price, future_price)", "spot_price > 0 AND future_price > 0"))
def carries(spark, sf_dir):
    p = sample(spark, sf_dir)
    spot = p.select(F.col("symbol").alias("underlying"), "date", F.col("close").alias("spot_price"))
    futures = p.select(F.col("symbol").alias("underlying"), "date", F.col("open").alias("future_price"), F.date_add(F.last_day("date"), 60).alias("expiry"))
    df = joins.carry(spot, futures)
    return df.select("underlying", "date", *[fixed(c).alias(c) for c in ("basis", "fair_basis", "annual_carry", "mispricing")])


@query("j17_triangular_product", f"WITH {BARS}, {BENCH}, v AS (SELECT sector, date, avg(open) AS o, avg(close) AS c FROM panel JOIN sectors USING (symbol) GROUP BY sector, date), rates AS (SELECT x.sector AS base, y.sector AS quote, x.date AS ts, x.o / y.c AS rate FROM v x JOIN v y ON x.date = y.date AND x.sector <> y.sector) SELECT a.base AS c1, a.quote AS c2, b.quote AS c3, a.ts, {fx('a.rate * b.rate * c.rate * pow(1 - 0.0005::DOUBLE, 3)')} AS net_product FROM rates a JOIN rates b ON a.quote = b.base AND a.ts = b.ts JOIN rates c ON b.quote = c.base AND c.quote = a.base AND c.ts = a.ts WHERE a.base < a.quote AND a.base < b.quote")
def circles(spark, sf_dir):
    v = sample(spark, sf_dir).groupBy(residual.sector_of(F.col("symbol")).alias("sector"), F.col("date").alias("ts")).agg(F.avg("open").alias("o"), F.avg("close").alias("c"))
    rates = v.select(F.col("sector").alias("base"), "ts", "o").join(v.select(F.col("sector").alias("quote"), "ts", "c"), "ts").filter("base <> quote").select("base", "quote", "ts", (F.col("o") / F.col("c")).alias("rate"))
    return joins.triangles(rates).select("c1", "c2", "c3", "ts", fixed("net_product").alias("net_product"))


@query("a36_rolling_pair_correlation", f"WITH {BARS}, j AS (SELECT p.symbol AS a, q.symbol AS b, p.date, p.returns AS ra, q.returns AS rb FROM panel p JOIN panel q ON p.date = q.date AND p.symbol < q.symbol), c AS (SELECT a, b, date, CASE WHEN count(*) OVER {PW} >= 60 AND stddev_pop(ra) OVER {PW} * stddev_pop(rb) OVER {PW} <> 0 THEN covar_pop(ra, rb) OVER {PW} / (stddev_pop(ra) OVER {PW} * stddev_pop(rb) OVER {PW}) END AS corr FROM j) SELECT a, b, count(corr) AS n, {fx('avg(corr)')} AS mean_corr, {fx('max(abs(corr))')} AS most, count(*) FILTER (abs(corr) >= 0.5) AS n_spikes FROM c GROUP BY a, b")
def correlations(spark, sf_dir):
    df = joins.rolling_pair_correlation(sample(spark, sf_dir))
    return df.groupBy("a", "b").agg(F.count("corr").alias("n"), fixed(F.avg("corr")).alias("mean_corr"), fixed(F.max(F.abs("corr"))).alias("most"), F.count_if("spike").alias("n_spikes"))


@query("a36_correlation_regimes", f"""WITH {BARS}, j AS (SELECT p.symbol AS a, q.symbol AS b, p.date, p.returns AS ra, q.returns AS rb FROM panel p JOIN panel q ON p.date = q.date AND p.symbol < q.symbol
  ), c AS (SELECT a, b, date, CASE WHEN stddev_pop(ra) OVER {PW} * stddev_pop(rb) OVER {PW} <> 0 THEN covar_pop(ra, rb) OVER {PW} / (stddev_pop(ra) OVER {PW} * stddev_pop(rb) OVER {PW}) END AS corr, count(*) OVER {PW} AS k FROM j
  ), h AS (SELECT *, count(corr) OVER o AS n, avg(corr) OVER o AS m, stddev_pop(corr) OVER o AS s FROM c WHERE k >= 60 WINDOW o AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)
  ), mk AS (SELECT date, avg(returns) AS m FROM panel GROUP BY date), v AS (SELECT date, CASE WHEN count(m) OVER d >= 20 THEN stddev_pop(m) OVER d END AS vol FROM mk WINDOW d AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
  ), g AS (SELECT date, CASE WHEN vol > quantile_cont(vol, 0.5) OVER (ORDER BY date) THEN 'high' WHEN vol IS NOT NULL THEN 'low' END AS regime FROM v)
  SELECT a, b, regime, count(corr) AS n, {fx('avg(corr)')} AS mean_corr, count(*) FILTER (n >= 60 AND abs(corr - m) > 3 * s) AS n_spikes FROM h JOIN g USING (date) GROUP BY a, b, regime""")
def regimes_of_pairs(spark, sf_dir):
    """Correlation of each pair by the market's volatility regime, and its jumps against its own history."""
    p = sample(spark, sf_dir)
    df = joins.correlation_regimes(joins.pair_correlations(p), p)
    return df.groupBy("a", "b", "regime").agg(F.count("corr").alias("n"), fixed(F.avg("corr")).alias("mean_corr"), F.count_if("spike").alias("n_spikes"))
