"""Fundamentals as they were known at a time: reports, restatements and estimates by fiscal period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof

#: What a row of a period's history is: its own report, that of the period a year before, or an estimate. At one time estimates come last: a report isn't measured by an estimate that came with it.
OWN, BASE, ESTIMATE = 0, 1, 2


def known_states(facts: DataFrame, estimates: DataFrame) -> DataFrame:
    """What was known of each symbol's latest period, at each time when that changed.

    facts(symbol, period, known, value) has a row for each report and restatement of the
    fiscal period that ends at period; estimates(symbol, period, known, estimate) alike.
    Two values of a period at one time: the larger one counts. Rows with a null symbol,
    period or known say nothing; null values neither.

    Each row speaks of its own period and of the one a year later, whose growth it is the
    base of, so a period's history is one sorted run of both kinds of rows, and what is
    known at a time is the last one of each kind: linear in the rows, without meeting
    periods with periods. A period counts from its first report until the first report of
    a later one; a later restatement of it, or of its base, opens a new state.

    Returns symbol, period, known, value and base as known then, reported (first known),
    first_value, estimate (the last one known before the first report).
    """
    f = facts.filter("symbol IS NOT NULL AND period IS NOT NULL AND known IS NOT NULL AND value IS NOT NULL").groupBy("symbol", "period", "known").agg(F.max("value").alias("v"))
    e = estimates.filter("symbol IS NOT NULL AND period IS NOT NULL AND known IS NOT NULL AND estimate IS NOT NULL").groupBy("symbol", "period", "known").agg(F.max("estimate").alias("v"))
    later = F.last_day(F.add_months("period", 12))
    rows = f.withColumn("kind", F.lit(OWN)).unionByName(f.select("symbol", later.alias("period"), "known", "v", F.lit(BASE).alias("kind"))).unionByName(e.withColumn("kind", F.lit(ESTIMATE)))
    w = Window.partitionBy("symbol", "period").orderBy("known", "kind").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda k: F.when(F.col("kind") == k, F.col("v"))
    rows = rows.withColumns({
        "value": F.last(of(OWN), ignorenulls=True).over(w), "base": F.last(of(BASE), ignorenulls=True).over(w), "_estimate": F.last(of(ESTIMATE), ignorenulls=True).over(w),
        "first_value": F.first(of(OWN), ignorenulls=True).over(w), "reported": F.min(F.when(F.col("kind") == OWN, F.col("known"))).over(w),
    })
    rows = rows.withColumn("estimate", F.first(F.when((F.col("kind") == OWN) & (F.col("known") == F.col("reported")), F.struct(F.col("_estimate").alias("e"))), ignorenulls=True).over(w)["e"])
    rows = rows.filter("reported IS NOT NULL AND kind <> 2")
    # several rows of one time: the last one knows all of them
    rows = rows.groupBy("symbol", "period", "known").agg(F.max_by(F.struct("value", "base", "reported", "first_value", "estimate"), "kind").alias("s")).select("symbol", "period", "known", "s.*")
    # a period ends when a later one is reported: one row for each period and symbol
    ends = rows.groupBy("symbol", "period").agg(F.min("reported").alias("_from"))
    after = Window.partitionBy("symbol").orderBy(F.desc("period")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("symbol", "period", F.min("_from").over(after).alias("_until"))
    return rows.join(ends, ["symbol", "period"]).filter("_until IS NULL OR known < _until").drop("_until")


def fundamental_context(decisions: DataFrame, facts: DataFrame, estimates: DataFrame, time: str = "date") -> DataFrame:
    """W72. decisions(symbol, time) with surprise, growth and age of the latest report known at their time.

    surprise is the first report less the estimate before it, over that estimate; growth
    compares with the same period a year before, both as known at the decision, so that a
    restatement changes what comes after it and nothing before.
    """
    s = known_states(facts, estimates)
    s = s.withColumns({"surprise": F.when(F.col("estimate") != 0, (F.col("first_value") - F.col("estimate")) / F.abs("estimate")), "growth": F.when(F.col("base") > 0, F.col("value") / F.col("base") - 1)})
    out = asof(decisions, s, ["symbol"], time, "known", ["period", "value", "surprise", "growth", "reported"])
    return out.withColumn("report_age", F.date_diff(time, "reported")).drop("asof_known", "reported")
