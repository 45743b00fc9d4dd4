"""Registered streaming queries (T-1 to T-9): each runs a stream over all events that are there and returns its rows; SQL states the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qpanel.functions.windows import fixed
from qpanel.sources.tables import shared_root
from qpanel.streaming import feeds

from .sql import fixed as fx

QUERIES, SQL = {}, {}

#: Rows later than the watermark never count, and windows that it has not passed stay open: the stream's result is that of the closed windows.
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def played(spark, sf_dir, make):
    """The stream's rows as a table: events in order of time form one batch, so that none is late."""
    t = feeds.ticks(spark, f"{sf_dir}/events.parquet")
    folder = f"{shared_root(spark)}-stream-{uuid.uuid4().hex}"
    return feeds.run_available(make(t), f"{folder}/rows", f"{folder}/state")


@query("t2_late_events", f"WITH e AS (SELECT *, event_id % 10 = 0 AS behind FROM events), w AS (SELECT max(ts) FILTER (NOT behind) - INTERVAL 10 MINUTE AS passed FROM e), t AS (SELECT e.*, time_bucket(INTERVAL 1 HOUR, ts) AS s FROM e, w WHERE NOT behind OR ts > passed) SELECT event_type AS symbol, s AS start, s + INTERVAL 1 HOUR AS \"end\", arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM t WHERE s + INTERVAL 1 HOUR <= {CLOSED} GROUP BY event_type, s")
def late(spark, sf_dir):
    """Events in two deliveries: nine tenths first, then the other tenth, which is late but for its end, with all of the first once more."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = f"{shared_root(spark)}-stream-{uuid.uuid4().hex}"
    behind = F.col("event_id") % 10 == 0
    for delivery in (events.filter(~behind), events):
        delivery.write.mode("append").parquet(f"{folder}/events")
        found = feeds.run_available(feeds.ohlcv(feeds.deduplicated(feeds.ticks(spark, f"{folder}/events", 1_000_000))), f"{folder}/rows", f"{folder}/state")
    return found


@query("t1_t3_live_bars", f"WITH t AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS s FROM events) SELECT event_type AS symbol, s AS start, s + INTERVAL 1 HOUR AS \"end\", arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM t WHERE s + INTERVAL 1 HOUR <= {CLOSED} GROUP BY event_type, s")
def live_bars(spark, sf_dir):
    return played(spark, sf_dir, lambda t: feeds.ohlcv(feeds.deduplicated(t)))


@query("t4_sliding_volume", f"WITH t AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(k AS INT)) AS s FROM events, range(24) q(k)) SELECT *, {fx('volume / avg(volume) OVER (PARTITION BY symbol ORDER BY start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)')} AS relative_volume FROM (SELECT event_type AS symbol, s AS start, s + INTERVAL 24 HOUR AS \"end\", count(*) AS volume FROM t WHERE s + INTERVAL 24 HOUR <= {CLOSED} GROUP BY event_type, s)")
def sliding(spark, sf_dir):
    windows = played(spark, sf_dir, lambda t: feeds.sliding_volume(feeds.deduplicated(t)))
    return feeds.relative_volume(windows).withColumn("relative_volume", fixed("relative_volume"))


@query("t5_sessions", f"WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), g AS (SELECT *, sum(b) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM a) SELECT event_type AS symbol, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n, min(value) AS low, max(value) AS high FROM g GROUP BY event_type, g HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}")
def spells(spark, sf_dir):
    return played(spark, sf_dir, lambda t: feeds.sessions(feeds.deduplicated(t)))


def delivered(spark, sf_dir, make, deliveries):
    """The rows of a stream that gets its events in several deliveries, each a batch: (a condition on the events, for each)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = f"{shared_root(spark)}-stream-{uuid.uuid4().hex}"
    for part in deliveries:
        events.filter(part).write.mode("append").parquet(f"{folder}/events")
        found = feeds.run_available(make(feeds.ticks(spark, f"{folder}/events", 1_000_000)), f"{folder}/rows", f"{folder}/state")
    return found


#: Deliveries out of order: events come by weeks, a third of them a week late, some two weeks late, and a fifth twice. Those behind the watermark of eight days are lost.
WEEK = "floor(date_diff('day', TIMESTAMP '2024-01-01', ts) / 10)"
DISORDER = f"""e AS (SELECT *, CAST({WEEK} AS INT) + CASE WHEN event_id % 17 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS d FROM events
  ), came AS (SELECT *, d AS batch FROM e UNION ALL SELECT *, d + 1 AS batch FROM e WHERE event_id % 5 = 0
  ), ends AS (SELECT b.batch, (SELECT max(ts) FROM came c WHERE c.batch < b.batch) - INTERVAL 11 DAY AS passed FROM (SELECT DISTINCT batch FROM came) b
  ), kept AS (SELECT DISTINCT event_id, ts, event_type, value FROM came JOIN ends USING (batch) WHERE passed IS NULL OR ts > passed
  ), fin AS (SELECT max(ts) - INTERVAL 11 DAY AS w FROM came)"""


def disordered(spark, sf_dir, make):
    d = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 10).cast("int") + F.when(F.col("event_id") % 17 == 0, 2).when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    again = F.col("event_id") % 5 == 0
    return delivered(spark, sf_dir, make, [(d == k) | (again & (d + 1 == k)) for k in range(6)])


@query("t6_stale_alarms", f"WITH g AS (SELECT event_type AS symbol, ts, lead(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) SELECT symbol, ts AS last_tick, ts + INTERVAL 1 HOUR AS alarm_at FROM g WHERE (n - ts >= INTERVAL 1 HOUR OR n IS NULL) AND ts + INTERVAL 1 HOUR <= {CLOSED}")
def alarms(spark, sf_dir):
    return played(spark, sf_dir, feeds.stale_alarms)


@query("t6_alarms_in_disorder", f"WITH {DISORDER}, g AS (SELECT event_type AS symbol, ts, lead(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM kept) SELECT symbol, ts AS last_tick, ts + INTERVAL 1 HOUR AS alarm_at FROM g, fin WHERE (n - ts >= INTERVAL 1 HOUR OR n IS NULL) AND ts + INTERVAL 1 HOUR <= w")
def late_alarms(spark, sf_dir):
    return disordered(spark, sf_dir, lambda t: feeds.stale_alarms(t, "11 days", 120 * feeds.MINUTE))


def running_sql(before, source, closed):
    """Each symbol's rows in order, one after the other: seeds by sums of the first values, then the recursions."""
    return f"""WITH RECURSIVE {before} t AS (
    SELECT event_type AS symbol, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM {source} WHERE ts <= {closed}
  ), walk(symbol, i, ts, last, total, e, gain, loss, up) AS (
    SELECT symbol, i, ts, value, value, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT FROM t WHERE i = 1
    UNION ALL
    SELECT t.symbol, t.i, t.ts, value, total + value, CASE WHEN t.i = 10 THEN (total + value) / 10 WHEN t.i > 10 THEN 2.0::DOUBLE / 11 * value + (1 - 2.0::DOUBLE / 11) * e END,
           CASE WHEN t.i < 15 THEN gain + greatest(value - last, 0) WHEN t.i = 15 THEN (gain + greatest(value - last, 0)) / 14 ELSE gain + (greatest(value - last, 0) - gain) / 14 END,
           CASE WHEN t.i < 15 THEN loss + greatest(last - value, 0) WHEN t.i = 15 THEN (loss + greatest(last - value, 0)) / 14 ELSE loss + (greatest(last - value, 0) - loss) / 14 END,
           CASE WHEN value > last THEN up + 1 ELSE 0 END
    FROM walk JOIN t ON t.symbol = walk.symbol AND t.i = walk.i + 1
  ) SELECT symbol, ts, last AS price, {fx('e')} AS ema_10, {fx('CASE WHEN i >= 15 THEN CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END END')} AS rsi_14, up AS run_up FROM walk"""


@query("t7_running_features", running_sql("", "events", CLOSED))
def running(spark, sf_dir):
    return played(spark, sf_dir, feeds.running_features).withColumns({c: fixed(c) for c in ("ema_10", "rsi_14")})


@query("t7_features_in_disorder", running_sql(DISORDER + ",", "kept", "(SELECT w FROM fin)"))
def late_running(spark, sf_dir):
    """Six deliveries out of order, with repeated and lost events: rows come in order all the same."""
    return disordered(spark, sf_dir, lambda t: feeds.running_features(t, "11 days", 120 * feeds.MINUTE)).withColumns({c: fixed(c) for c in ("ema_10", "rsi_14")})


@query("t8_stream_static_join", "SELECT event_id, event_type AS symbol, value AS price, upper(event_type) AS sector FROM events")
def joined(spark, sf_dir):
    static = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol")).distinct().withColumn("sector", F.upper("symbol"))
    return played(spark, sf_dir, lambda t: feeds.enriched(t, static).select("event_id", "symbol", "price", "sector"))


@query("t9_stream_stream_join", f"WITH h AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ends FROM events), b AS (SELECT event_type, ends, arg_max(value, (ts, event_id)) AS close FROM h WHERE ends <= {CLOSED} GROUP BY event_type, ends), c AS (SELECT *, ends - INTERVAL 1 MICROSECOND AS bar_ts FROM b) SELECT s.event_type AS symbol, s.ts AS signal_ts, bar_ts, close FROM events s JOIN c ON s.event_type = c.event_type AND bar_ts > s.ts AND bar_ts <= s.ts + INTERVAL 4 HOUR")
def met(spark, sf_dir):
    """Every event as a signal, with the hourly bars of its symbol that close in the four hours after it."""
    return played(spark, sf_dir, lambda t: feeds.signals_with_bars(t.select("symbol", F.col("ts").alias("signal_ts")), feeds.closed_bars(t)))
