"""Scalar expressions over text and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens that count as true and as nothing, and points of a grade. Fixed values.
TRUE_TOKENS = ("true", "1", "yes", "y", "on")
EMPTY_TOKENS = ("", "nan", "none", "null")
GRADES = {"A": 90, "B+": 84, "B": 80, "C+": 74, "C": 70, "D": 60, "F": 45}


def is_true_token(x: Column) -> Column:
    """P10."""
    return F.coalesce(F.lower(F.trim(x)).isin(*TRUE_TOKENS), F.lit(False))


def is_empty_token(x: Column) -> Column:
    """P11."""
    return F.coalesce(F.lower(F.trim(x)).isin(*EMPTY_TOKENS), F.lit(True))


def signed_percent(x: Column) -> Column:
    """P12. +1.23%"""
    return F.when(x.isNotNull(), F.format_string("%+.2f%%", x * 100))


def grade_score(grade: Column) -> Column:
    """P13. Points of a grade as text, or the grade itself."""
    points = F.create_map(*[v for k, n in GRADES.items() for v in (F.lit(k), F.lit(str(n)))])
    return F.coalesce(points[F.upper(F.trim(grade))], grade)


def iso_time(x: Column) -> Column:
    """P15. A time with Z or an offset."""
    return F.try_to_timestamp(x)


def calendar(spark: SparkSession, first: str, last: str, holidays: DataFrame | None = None) -> DataFrame:
    """P16. Weekdays that are no holidays, each with the next one."""
    from pyspark.sql import Window

    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date"))
    days = days.filter(F.weekday("date") < 5)
    if holidays is not None:
        days = days.join(holidays, "date", "left_anti")
    return days.withColumn("next_trading_day", F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date")))


def candle(previous_close: Column) -> dict[str, Column]:
    """P18. Shape of a bar: body and wicks as shares of the range, close location, range and gap in percent."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = h - l
    share = lambda x: F.when(span > 0, x / span)
    return {
        "body_pct": share(F.abs(c - o)), "upper_wick_pct": share(h - F.greatest(o, c)), "lower_wick_pct": share(F.least(o, c) - l),
        "clv": share((c - l) - (h - c)), "range_pct": F.when(c > 0, span / c), "gap_pct": F.when(previous_close > 0, o / previous_close - 1),
    }


def calendar_features(date: str = "date") -> dict[str, Column]:
    """P19. Day of the week, windows at the ends of months and quarters, and the week of the third Friday."""
    d = F.col(date)
    end = F.last_day(d)
    first = F.trunc(d, "month")
    # weekday(): 0 is Monday, 4 Friday
    third_friday = F.date_add(first, F.pmod(F.lit(4) - F.weekday(first), F.lit(7)) + 14)
    return {
        "day_of_week": F.weekday(d), "month_end_window": F.date_diff(end, d) <= 3, "quarter_end_window": (F.date_diff(end, d) <= 3) & (F.month(d) % 3 == 0),
        "opex_week": F.trunc(d, "week") == F.trunc(third_friday, "week"), "days_to_month_end": F.date_diff(end, d),
    }
