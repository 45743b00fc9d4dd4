"""Bars: from finer tables, from files, checked, cleaned and built into a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qpanel.functions.windows import by_symbol, lag

BAR_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume"]
MIN_BARS = 60
TIME_NAMES = ("date", "timestamp", "datetime", "time")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4. Daily bars from order lines: the symbol is the part's brand, the price of a unit the price.

    Lines are combined within map tasks, so one row per symbol and day is shuffled from each.
    """
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    ticks = lines.filter(F.col("l_quantity") > 0).join(part, lines["l_partkey"] == part["p_partkey"])
    ticks = ticks.select(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("date"), px.alias("px"), F.col("l_quantity").alias("qty"), F.struct("l_orderkey", "l_linenumber", px.alias("px")).alias("at"))
    return ticks.groupBy("symbol", "date").agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"), F.sum("qty").alias("volume")
    )


def read_csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """S1. Bar files, one per symbol: the time column may have any of TIME_NAMES, low defaults to close; rows without time or close are dropped."""
    raw = spark.read.option("header", True).csv(path)
    have = {c.lower(): c for c in raw.columns}
    time = next((have[n] for n in TIME_NAMES if n in have), None)
    if time is None:
        raise ValueError(f"no time column among {raw.columns}")
    number = lambda n: F.expr(f"try_cast(`{have[n]}` AS double)") if n in have else F.lit(None).cast("double")
    symbol = F.col(have["symbol"]) if "symbol" in have else F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    when = F.coalesce(F.try_to_timestamp(F.col(time)), F.try_to_timestamp(F.col(time), F.lit("yyyy-MM-dd")))
    df = raw.select(symbol.alias("symbol"), when.alias("timestamp"), *[number(n).alias(n) for n in ("open", "high", "low", "close", "volume")])
    df = df.filter(F.col("timestamp").isNotNull() & F.col("close").isNotNull())
    return df.withColumn("low", F.coalesce("low", "close")).withColumn("date", F.to_date("timestamp"))


def sample_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(bars_from_lines(spark, sf_dir))


def panel(bars: DataFrame, start: str | None = None, end: str | None = None, warmup_days: int = 365, least: int = MIN_BARS) -> DataFrame:
    """S2, S3. The panel of all symbols: NaN becomes NULL, symbols with fewer than least bars go, returns are added, 0 at the first bar.

    Bars from warmup_days before start are kept for the windows; trim() takes them off.
    """
    df = bars.select("symbol", "date", *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in BAR_COLUMNS[2:]])
    if start:
        df = df.filter(F.col("date") >= F.date_sub(F.to_date(F.lit(start)), warmup_days))
    if end:
        df = df.filter(F.col("date") <= F.to_date(F.lit(end)))
    before = lag("close")
    df = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).filter(F.col("_n") >= least).drop("_n")
    return df.withColumns(
        {
            "i": F.row_number().over(by_symbol()),
            "returns": F.coalesce(F.when(before > 0, F.col("close") / before - 1), F.lit(0.0)),
            "log_returns": F.coalesce(F.when((before > 0) & (F.col("close") > 0), F.ln(F.col("close") / before)), F.lit(0.0)),
        }
    )


def trim(features: DataFrame, start: str) -> DataFrame:
    """Rows from start on, after the windows have used what came before."""
    return features.filter(F.col("date") >= F.to_date(F.lit(start)))


def bad_bar(kind: str) -> Column:
    o, h, l, c, v = (F.col(x) for x in BAR_COLUMNS[2:])
    return {
        "bad_ohlc": ~((l <= o) & (o <= h) & (l <= c) & (c <= h)),
        "negative_volume": v < 0,
        "zero_price": (o <= 0) | (h <= 0) | (l <= 0) | (c <= 0),
        "missing": o.isNull() | h.isNull() | l.isNull() | c.isNull() | v.isNull(),
    }[kind]


def validate(bars: DataFrame) -> DataFrame:
    """S5. One row with the number of bars and of each fault; a missing column is an error."""
    if lost := [c for c in BAR_COLUMNS if c not in bars.columns]:
        raise ValueError(f"missing columns: {lost}")
    return bars.agg(F.count(F.lit(1)).alias("n_bars"), *[F.count_if(bad_bar(k)).alias(k) for k in ("bad_ohlc", "negative_volume", "missing")])


def quarantine(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S5. Bars without a fault, and those with one."""
    bad = F.coalesce(bad_bar("bad_ohlc") | bad_bar("negative_volume"), F.lit(False)) | bad_bar("missing")
    return bars.filter(~bad), bars.filter(bad)


def normalise(bars: DataFrame, order_col: str = "ingest_order") -> DataFrame:
    """S6. Symbols trimmed and in upper case; of bars with the same symbol and date the last one to arrive stays."""
    df = bars.withColumn("symbol", F.upper(F.trim("symbol")))
    last = Window.partitionBy("symbol", "date").orderBy(F.col(order_col).desc())
    return df.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def weekdays_before(date: Column) -> Column:
    """Monday to Friday dates from 1970-01-05, a Monday, to the day before."""
    n = F.date_diff(date, F.lit("1970-01-05").cast("date"))
    return 5 * F.floor(n / 7) + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def quality_profile(bars: DataFrame) -> DataFrame:
    """S7. Faults of each symbol's bars and a score out of 100.

    Sessions are Mondays to Fridays: missing_days are those between a symbol's first and
    last bar without one, out_of_session its bars on other days. Missing days count in
    the score by their share of the sessions.
    """
    before, z = lag("close"), Window.partitionBy("symbol")
    df = bars.withColumn("_ret", F.when(before > 0, F.col("close") / before - 1)).withColumn("_same", F.col("close") == before)
    df = df.withColumn("_z", F.try_divide(F.abs(F.col("_ret") - F.avg("_ret").over(z)), F.stddev_pop("_ret").over(z)))
    df = df.withColumn("_dup", F.count(F.lit(1)).over(Window.partitionBy("symbol", "date")) - 1)
    df = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.count_if(F.col("_dup") > 0).alias("duplicates"),
        (weekdays_before(F.date_add(F.max("date"), 1)) - weekdays_before(F.min("date"))).cast("long").alias("_sessions"),
        F.countDistinct(F.when(F.weekday("date") < 5, F.col("date"))).alias("_met"),
        F.count_if(F.weekday("date") >= 5).alias("out_of_session"),
        F.count_if(bad_bar("zero_price")).alias("zero_price"),
        F.count_if(bad_bar("bad_ohlc")).alias("bad_ohlc"),
        F.count_if(bad_bar("negative_volume")).alias("negative_volume"),
        F.count_if(F.col("_z") > 4).alias("outliers"),
        F.count_if(F.col("_same")).alias("flatline"),
    )
    df = df.withColumn("missing_days", F.col("_sessions") - F.col("_met"))
    absent = 10 * F.coalesce(F.try_divide("missing_days", "_sessions"), F.lit(0.0))
    share = lambda c, w: w * F.col(c) / F.col("n_bars")
    return df.withColumn("score", F.greatest(F.lit(0.0), 100.0 - absent - share("duplicates", 10) - share("bad_ohlc", 20) - share("outliers", 10) - share("zero_price", 10) - share("negative_volume", 10))).drop("_sessions", "_met")
