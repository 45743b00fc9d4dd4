"""Live bars and signals (T-1 to T-9) with the same definitions as the batch side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELAY = "10 minutes"
#: In microseconds.
MINUTE = 60_000_000


def ticks(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the files of an events table, as ticks: event_id, ts, symbol, price, user_id."""
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # a single file is read through its folder
    folder, _, name = path.rstrip("/").rpartition("/")
    s = s.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else s.parquet(path)
    return as_ticks(s)


def as_ticks(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), "user_id")


def deduplicated(t: DataFrame, delay: str = DELAY) -> DataFrame:
    """T-1, T-2. Each event once; state for an event is dropped when the watermark has passed it."""
    return t.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def ohlcv(t: DataFrame, width: str = "1 hour") -> DataFrame:
    """T-3. Bars of closed windows, labelled by start and end."""
    at = F.struct("ts", "event_id")
    b = t.groupBy("symbol", F.window("ts", width)).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return b.select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "open", "high", "low", "close", "volume")


def sliding_volume(t: DataFrame, width: str = "1 day", step: str = "1 hour") -> DataFrame:
    """T-4. Ticks of sliding windows, the stream's part of relative_volume()."""
    b = t.groupBy("symbol", F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("volume"))
    return b.select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "volume")


def relative_volume(windows: DataFrame, n: int = 20) -> DataFrame:
    """T-4. Closed windows with their volume over the mean of the n windows of the symbol before them."""
    before = Window.partitionBy("symbol").orderBy("start").rowsBetween(-n, -1)
    return windows.withColumn("relative_volume", F.try_divide(F.col("volume"), F.avg("volume").over(before)))


def sessions(t: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """T-5. Spells of activity that end with a gap."""
    b = t.groupBy("symbol", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))
    return b.select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "low", "high")


def enriched(t: DataFrame, sector_map: DataFrame) -> DataFrame:
    """T-8. Ticks with a static table, joined batch by batch."""
    return t.join(sector_map, "symbol", "left")


def signals_with_bars(signals: DataFrame, bars: DataFrame, delay: str = DELAY, hold: str = "4 hours", parts: int = 4) -> DataFrame:
    """T-9. Signals (symbol, signal_ts) and later bars (symbol, bar_ts, close) within a span: both sides' state is bounded by the watermarks.

    A signal belongs to one stretch of time, a part of the span; a bar goes to each stretch
    in which its signals can be, so that it meets these alone and not all of its symbol.
    Bars may be those of closed_bars(), whose time carries the watermark of their ticks.
    """
    s = signals.withWatermark("signal_ts", delay)
    b = bars if bars.isStreaming and "_closed" in bars.columns else bars.withWatermark("bar_ts", delay)
    # plain numbers: a key with a watermark of its own would let state go by that
    width = F.expr(f"CAST(ceil(unix_micros(timestamp_micros(0) + INTERVAL {hold}) / {parts}) AS LONG)")
    stretch = lambda us: us - F.pmod(us, width)
    s = s.withColumn("_stretch", stretch(F.unix_micros("signal_ts"))).alias("s")
    first, last = F.unix_micros(F.expr(f"bar_ts - INTERVAL {hold}")), F.unix_micros("bar_ts") - 1
    b = b.withColumn("_stretch", F.explode(F.sequence(stretch(first), stretch(last), width))).alias("b")
    return s.join(b, F.expr(f"s.symbol = b.symbol AND s._stretch = b._stretch AND b.bar_ts > s.signal_ts AND b.bar_ts <= s.signal_ts + INTERVAL {hold}")).select("s.symbol", "signal_ts", "bar_ts", "close")


def closed_bars(t: DataFrame, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Bars of closed windows for joins with other streams: bar_ts is the last microsecond of the window."""
    at = F.struct("ts", "event_id")
    b = t.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width)).agg(F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return b.select("symbol", F.window_time("window").alias("bar_ts"), "close", "volume", F.lit(True).alias("_closed"))


def in_time(parts: list[np.ndarray]) -> np.ndarray:
    """The rows of all parts by time and event."""
    rows = np.concatenate(parts)
    return rows[np.lexsort((rows["event"], rows["us"]))]


class InOrder(StatefulProcessor):
    """Rows of a key in order of time and event, each once, whatever the order of the micro-batches that bring them.

    A row waits in a buffer until the watermark reaches it; then the rows up to there are
    sorted, repeats are left out, and passed() gets them. Rows at or before the watermark
    come too late and are dropped, as rows of their time have gone on already.

    The buffer has sorted blocks of rows by the time of their first: incoming rows are
    taken from the iterator chunk by chunk, sorted as many at a time as memory may hold,
    and cut where a new span of time begins, once a block is large enough. So a row is
    written once, whatever the order of rows and the number of spans. State: the rows
    within the watermark's delay, and whatever the subclass keeps. Span and sizes change
    the number of entries, never a result.
    """

    row = np.dtype([("us", "<i8"), ("event", "<i8"), ("price", "<f8")])
    #: Rows: sorted at a time, at least and at most in a block, at least for passed() if as many are due.
    run, least, most, step = 500_000, 1_000, 20_000, 50_000

    def __init__(self, span: int = MINUTE):
        # in microseconds, as all times below
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("buffer", T.StructType([T.StructField("us", T.LongType()), T.StructField("part", T.LongType())]), T.StructType([T.StructField("rows", T.BinaryType())]))
        self.due = handle.getValueState("due", T.StructType([T.StructField("ms", T.LongType())]))

    def passed(self, key, rows: np.ndarray) -> pd.DataFrame | None:
        """What rows, which follow all those before, give rise to."""
        raise NotImplementedError

    def quiet_until(self, key, watermark: int) -> pd.DataFrame | None:
        """What the absence of rows up to the watermark gives rise to."""
        return None

    def next_due(self) -> int | None:
        """The first millisecond at which quiet_until() has something to say, if no row comes."""
        return None

    def wake(self, ms: int) -> None:
        """One timer for a key: the earliest of those asked for."""
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or ms < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def store(self, rows: np.ndarray) -> None:
        """Puts sorted rows into the buffer, block by block."""
        starts, at = np.flatnonzero(np.diff(rows["us"] // self.span)) + 1, 0
        while at < len(rows):
            k = int(np.searchsorted(starts, at + self.least))
            end = min(int(starts[k]) if k < len(starts) else len(rows), at + self.most)
            us, part = int(rows["us"][at]), 0
            while self.buffer.containsKey((us, part)):
                part += 1
            self.buffer.updateValue((us, part), (rows[at:end].tobytes(),))
            at = end

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, first, waiting = timerValues.getCurrentWatermarkInMs() * 1000, None, []
        for chunk in rows:
            found = np.empty(len(chunk), dtype=self.row)
            found["us"] = chunk["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            found["event"], found["price"] = chunk["event_id"].to_numpy(), chunk["price"].to_numpy(dtype=float, na_value=np.nan)
            found = found[found["us"] > watermark]
            if len(found):
                first = min(int(found["us"].min()), first if first is not None else int(found["us"].max()))
                waiting.append(found)
            if sum(map(len, waiting)) >= self.run:
                self.store(in_time(waiting))
                waiting = []
        if waiting:
            self.store(in_time(waiting))
        if first is not None:
            self.wake(-(-first // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        blocks = sorted(tuple(k) for k in self.buffer.keys())
        due = sum(us <= watermark for us, _ in blocks)
        held, carried = [], 0
        for k, block in enumerate(blocks[:due]):
            held.append(np.frombuffer(bytes(self.buffer.getValue(block)[0]), dtype=self.row))
            self.buffer.removeKey(block)
            if k + 1 < due and sum(map(len, held)) < 2 * carried + self.step:
                continue
            rows = in_time(held)
            # the blocks to come have no row before the first of the next
            ready = int(np.searchsorted(rows["us"], blocks[k + 1][0], side="left")) if k + 1 < due else int(np.searchsorted(rows["us"], watermark, side="right"))
            held, carried = [rows[ready:]], len(rows) - ready
            if ready:
                rows = rows[:ready]
                once = np.r_[True, (rows["us"][1:] != rows["us"][:-1]) | (rows["event"][1:] != rows["event"][:-1])]
                out = self.passed(key, rows[once])
                if out is not None and len(out):
                    yield out
        waiting = [us for us, _ in blocks[due : due + 1]]
        if carried:
            self.store(held[0])
            waiting.append(int(held[0]["us"][0]))
        if waiting:
            self.wake(-(-min(waiting) // 1000))
        out = self.quiet_until(key, watermark)
        if out is not None and len(out):
            yield out
        ms = self.next_due()
        if ms is not None:
            self.wake(ms)

    def close(self) -> None:
        pass


def times(us) -> pd.Series:
    return pd.to_datetime(pd.Series(us, dtype="int64"), unit="us")


RUNNING = T.StructType([T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("total", "mean", "gain", "loss", "last")], T.StructField("up", T.LongType())])
RUNNING_OUT = "symbol string, ts timestamp, price double, ema_10 double, rsi_14 double, run_up long"


class RunningFeatures(InOrder):
    """T-7. EMA, Wilder's RSI and the length of the rising run, carried on from the last values, with the batch kernels' seeds: means of the first values."""

    period, strength = 10, 14

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("running", RUNNING)

    def passed(self, key, rows: np.ndarray) -> pd.DataFrame:
        n, total, mean, gain, loss, last, up = self.state.get() if self.state.exists() else (0, 0.0, None, 0.0, 0.0, None, 0)
        share, out = 2 / (self.period + 1), []
        for us, price in zip(rows["us"].tolist(), rows["price"].tolist()):
            n, total = n + 1, total + price
            if n == self.period:
                mean = total / n
            elif n > self.period:
                mean = share * price + (1 - share) * mean
            if last is not None:
                rise, fall = max(price - last, 0.0), max(last - price, 0.0)
                if n <= self.strength + 1:
                    gain, loss = gain + rise, loss + fall
                    if n == self.strength + 1:
                        gain, loss = gain / self.strength, loss / self.strength
                else:
                    gain, loss = gain + (rise - gain) / self.strength, loss + (fall - loss) / self.strength
            strength = None if n <= self.strength else 100.0 if loss == 0 else 100.0 - 100.0 / (1.0 + gain / loss)
            up = up + 1 if last is not None and price > last else 0
            last = price
            out.append((price, mean, strength, up))
        self.state.update((n, total, mean, gain, loss, last, up))
        price, mean, strength, up = zip(*out)
        return pd.DataFrame({"symbol": pd.Series([key[0]] * len(out), dtype=object), "ts": times(rows["us"]), "price": price, "ema_10": pd.Series(mean, dtype=float), "rsi_14": pd.Series(strength, dtype=float), "run_up": up})


def in_order(t: DataFrame, processor: InOrder, out: str, delay: str) -> DataFrame:
    return t.select("symbol", "ts", "event_id", "price").withWatermark("ts", delay).groupBy("symbol").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def running_features(t: DataFrame, delay: str = DELAY, span: int = MINUTE) -> DataFrame:
    """T-7. Running features of all ticks that the watermark has reached; prices are present."""
    return in_order(t, RunningFeatures(span), RUNNING_OUT, delay)


ALARM_OUT = "symbol string, last_tick timestamp, alarm_at timestamp"


class StaleAlarm(InOrder):
    """T-6. A row for each hour without a tick, once the watermark has passed that hour: no tick can fill it any more.

    State: the last tick, and whether its alarm was raised.
    """

    quiet = 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType()), T.StructField("raised", T.BooleanType())]))

    def alarms(self, key, ticks: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"symbol": pd.Series([key[0]] * len(ticks), dtype=object), "last_tick": times(ticks), "alarm_at": times(np.asarray(ticks) + self.quiet)})

    def passed(self, key, rows: np.ndarray) -> pd.DataFrame:
        old, raised = self.last.get() if self.last.exists() else (None, True)
        at = rows["us"] if old is None else np.r_[old, rows["us"]]
        stale = at[:-1][np.diff(at) >= self.quiet]
        if raised and old is not None:
            stale = stale[stale != old]
        latest = int(at[-1])
        self.last.update((latest, raised and latest == old))
        return self.alarms(key, stale)

    def quiet_until(self, key, watermark: int) -> pd.DataFrame | None:
        if not self.last.exists():
            return None
        latest, raised = self.last.get()
        if raised or latest + self.quiet > watermark:
            return None
        self.last.update((latest, True))
        return self.alarms(key, np.array([latest]))


    def next_due(self) -> int | None:
        latest, raised = self.last.get() if self.last.exists() else (0, True)
        return None if raised else -(-(latest + self.quiet) // 1000)


def stale_alarms(t: DataFrame, delay: str = DELAY, span: int = MINUTE) -> DataFrame:
    return in_order(t, StaleAlarm(span), ALARM_OUT, delay)


#: The state store that timers and several states of one key need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there now, into Parquet files in a shared folder, and returns that table.

    Run again with the same folders after more files have come, it goes on where it was.
    """
    from pyspark.errors import AnalysisException

    spark = df.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    try:
        return spark.read.schema(df.schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], df.schema)
