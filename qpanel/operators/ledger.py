"""Signal ledgers: cards, maturity scoreboard, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qpanel.functions.text import grade_score, signed_percent

from .joins import bars_after

#: Shares of the signal's close that make the price area, the break and the improvement level. Fixed values.
AREA, BREAK, IMPROVE = 0.03, 0.04, 0.02
CHECKPOINTS = (5, 10, 20)
WINDOW_BARS = 10

#: Texts of cards and scoreboard. Fixed values.
PULLBACK, PROOF, WEAK, BULLISH = "Waiting for Pullback", "Waiting for Stronger Proof", "Weakening", "Bullish Swing Setup"
STRETCHED, HIGH_RISK = "Too Stretched", "High Risk Setup"
SHORT_RANGE, SWING_RANGE = "Short-Term Setup: 1–5 trading days", "Swing Setup: 5–30 trading days"
CHANGES = (
    "Large short-term move increased pullback risk.",
    "Recent pullback reduced confidence in follow-through.",
    "Setup structure is mostly unchanged; proof window is still open.",
    "Setup stayed within expected range during the latest period.",
)
MISSING, BROKE, MATURING = "Insufficient Data", "Setup Broke", "Still Maturing"


def price(x: Column) -> Column:
    return F.round(x, 2)


def card_view(observations: DataFrame) -> DataFrame:
    """B1. Main view, risk, change and levels of an observation (outcome_status, signal_close, ret_5d)."""
    pending = F.upper(F.trim(F.coalesce("outcome_status", F.lit("")))) == "PENDING"
    r, c = F.col("ret_5d"), F.col("signal_close")
    view = F.when(pending & (r >= 0.15), PULLBACK).when(pending, PROOF).when(r <= -0.08, WEAK).otherwise(BULLISH)
    risk = F.when(r >= 0.15, STRETCHED).when(r <= -0.05, WEAK).otherwise(HIGH_RISK)
    changed = F.when(r >= 0.15, CHANGES[0]).when(r <= -0.05, CHANGES[1]).when(pending, CHANGES[2]).otherwise(CHANGES[3])
    df = observations.withColumns(
        {
            "main_view": view, "main_risk": risk, "what_changed": changed, "area_low": price(c * (1 - AREA)), "area_high": price(c * (1 + AREA)),
            "setup_breaks_below": price(c * (1 - BREAK)), "setup_breaks_above": price(c * (1 + IMPROVE)),
        }
    )
    sentence = F.format_string("Currently %s. The price area that matters is %.2f to %.2f; it breaks below %.2f and improves above %.2f.", "main_view", "area_low", "area_high", "setup_breaks_below", "setup_breaks_above")
    return df.withColumn("time_range", F.when(F.col("main_view") == PULLBACK, SHORT_RANGE).otherwise(SWING_RANGE)).withColumn("plain_english", sentence)


def cards(observations: DataFrame, progress: DataFrame, grade: str) -> DataFrame:
    """B2. Cards with progress(symbol, future_bars, bars_remaining) and the score of the lineage's grade."""
    df = card_view(observations.withColumn("symbol", F.upper(F.trim("symbol")))).join(progress, "symbol", "left")
    text = F.when(F.col("bars_remaining").isNotNull() & F.col("future_bars").isNotNull(), F.format_string("%d/%d bars recorded; %d bars remaining.", "future_bars", F.lit(WINDOW_BARS), "bars_remaining")).otherwise("Not enough proof yet; maturity progress unavailable.")
    pending = F.upper(F.trim("outcome_status")) == "PENDING"
    return df.withColumns({"score": grade_score(F.lit(grade)), "progress": text, "maturity_status": F.when(pending, "still maturing").otherwise("matured")})


def maturity(elapsed: Column, missing: Column, broke: Column) -> Column:
    """B4."""
    return F.when(missing, MISSING).when(broke, BROKE).when(elapsed >= 20, "20-Day Mature").when(elapsed >= 10, "10-Day Mature").when(elapsed >= 5, "5-Day Mature").otherwise(MATURING)


def scoreboard(observations: DataFrame, bars: DataFrame, most: int = 20) -> DataFrame:
    """B3-B6, J8. One row per observation (observation_id, symbol, signal_date, signal_close): checkpoints, break, status.

    Only the first `most` bars after a signal can change a row but for the number of
    bars elapsed and the current price, which come from the symbol's bar count and last
    close: a signal is never joined with a symbol's whole history.
    """
    card = card_view(observations)
    own = bars.groupBy("symbol").agg(F.max("i").alias("_bars"), F.max_by("close", "date").alias("current_price"), F.count(F.lit(1)).alias("_n"))
    low_after = lowest_after(card, bars)
    later = bars_after(card.select("observation_id", "symbol", "signal_date"), bars, most)
    at = later.groupBy("observation_id").agg(*[F.max(F.when(F.col("after") == k, F.col("bar_close"))).alias(f"_c{k}") for k in CHECKPOINTS])
    df = card.join(own, "symbol", "left").join(at, "observation_id", "left").join(low_after, "observation_id", "left")
    elapsed = F.coalesce(F.col("_bars") - F.col("_at"), F.lit(0))
    missing = F.col("_n").isNull()
    broke = F.coalesce(F.col("_low") <= F.col("setup_breaks_below"), F.lit(False))
    results = {f"result_{k}_day": F.when(F.col("signal_close") > 0, signed_percent(F.col(f"_c{k}") / F.col("signal_close") - 1)) for k in CHECKPOINTS}
    df = df.withColumns({"bars_elapsed": elapsed, "setup_broke": broke, "maturity_status": maturity(elapsed, missing, broke), **results})
    return df.select("observation_id", "symbol", "signal_date", "main_view", "signal_close", "setup_breaks_below", "current_price", "bars_elapsed", "setup_broke", "maturity_status", *results)


def lowest_after(observations: DataFrame, bars: DataFrame) -> DataFrame:
    """B5. Each observation's bar number and the lowest low of all later bars: a running minimum from the end, met by an as-of join."""
    from pyspark.sql import Window

    from .joins import asof

    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    future = bars.select("symbol", "date", F.col("i").alias("_at"), F.min("low").over(w).alias("_later"))
    whole = bars.groupBy("symbol").agg(F.min("low").alias("_all"))
    found = asof(observations.select("observation_id", "symbol", "signal_date"), future, ["symbol"], "signal_date", "date", ["_at", "_later"]).join(whole, "symbol", "left")
    return found.select("observation_id", F.coalesce("_at", F.lit(0)).alias("_at"), F.when(F.col("_at").isNull(), F.col("_all")).otherwise(F.col("_later")).alias("_low"))


def rejects(hypotheses: DataFrame) -> DataFrame:
    """B7."""
    return hypotheses.filter(F.lower(F.trim("status")) == "archived").withColumn("main_view", F.lit("No Edge"))


def sections(card_rows: DataFrame) -> DataFrame:
    """B8. The sections that a card belongs to."""
    v = F.col("main_view")
    found = F.array_compact(F.array(F.when(v == BULLISH, "bullish"), F.when(v.startswith("Waiting"), "waiting"), F.when(v == WEAK, "no_edge"), F.when(F.col("main_risk") == STRETCHED, "too_stretched")))
    return card_rows.select("*", F.explode(found).alias("section"))


def counts(observations: DataFrame) -> DataFrame:
    """B9."""
    s = F.upper(F.trim("outcome_status"))
    return observations.agg(F.count(F.lit(1)).alias("observations"), F.count_if(s != "PENDING").alias("outcomes"), F.count_if(s == "PENDING").alias("pending"))


def weather(grade: Column) -> Column:
    return F.when(F.upper(F.trim(grade)).isin("A", "B+", "B", "C+"), "Supportive").otherwise("Cautious")


def freshness(symbols: DataFrame, bars: DataFrame, as_of: str, stale_days: int = 4) -> DataFrame:
    """B10. symbols(symbol, signal_date): last bar, rows, bars after the signal, and whether the data are missing or stale at a given date."""
    agg = bars.groupBy("symbol").agg(F.max("date").alias("last_date"), F.count(F.lit(1)).alias("rows"))
    df = symbols.join(agg, "symbol", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    after = bars_after(symbols, bars, WINDOW_BARS).groupBy("symbol", "signal_date").agg(F.count(F.lit(1)).alias("bars_after"))
    df = df.join(after, ["symbol", "signal_date"], "left").withColumn("bars_after", F.coalesce("bars_after", F.lit(0)))
    status = F.when(F.col("last_date").isNull(), "MISSING").when(F.date_diff(F.to_date(F.lit(as_of)), "last_date") > stale_days, "STALE").otherwise("FRESH")
    # What is left of the observation window
    return df.withColumns({"status": status, "bars_remaining": F.greatest(F.lit(0), F.lit(WINDOW_BARS) - F.col("bars_after"))})
