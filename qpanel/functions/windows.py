"""Window specifications and expressions that all features share.

Windows count rows, never calendar time. All frames over one symbol use the same
partitioning and order, so that Spark needs one exchange and one sort for them.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def trailing(n: int) -> WindowSpec:
    """The last n rows, the current one included."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def running() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def across() -> WindowSpec:
    """All symbols of a date."""
    return Window.partitionBy("date")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def from_bar(x: Column, first: int) -> Column:
    """NULL before the symbol's bar number first."""
    return F.when(F.col("i") >= first, x)


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(by_symbol())


def ratio(num: Column, den: Column) -> Column:
    """num / den where den is positive, else NULL."""
    return F.when(den > 0, num / den)


def mean0(x: str | Column, n: int) -> Column:
    """Mean of n rows with missing values as 0, from row n on."""
    return from_bar(F.sum(F.coalesce(col(x), F.lit(0.0))).over(trailing(n)) / n, n)


def std(x: str | Column, n: int, first: int | None = None) -> Column:
    """Population deviation of the values present in n rows."""
    return from_bar(F.stddev_pop(col(x)).over(trailing(n)), first or n)


def low(x: str | Column, n: int) -> Column:
    return from_bar(F.min(col(x)).over(trailing(n)), n)


def high(x: str | Column, n: int) -> Column:
    return from_bar(F.max(col(x)).over(trailing(n)), n)


def change(x: str | Column, k: int) -> Column:
    """(x - x k rows ago) / x k rows ago, where that is positive."""
    before = lag(x, k)
    return ratio(col(x) - before, before)


def safe_corr(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation, NULL at zero variance."""
    w = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return F.try_divide(w(F.covar_pop(x, y)), w(F.stddev_pop(x)) * w(F.stddev_pop(y)))


def fixed(x: str | Column, digits: int = 6) -> Column:
    """Rounded half up on the number line: the same in every engine."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + 0.5) / scale
