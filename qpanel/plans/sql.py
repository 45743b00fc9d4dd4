"""Pieces of the SQL that states the results of the registered queries."""

from __future__ import annotations

#: Bars of each brand and day, the panel with returns, and windows w (by symbol) and x (by date) to build on.
BARS = """
ticks AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, l_quantity AS qty, l_orderkey AS k1, l_linenumber AS k2
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0
), bars AS (
  SELECT symbol, date, first(px ORDER BY k1, k2, px) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY k1, k2, px) AS close, sum(qty) AS volume
  FROM ticks GROUP BY symbol, date
), counted AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_all FROM bars
), panel AS (
  SELECT symbol, date, open, high, low, close, volume, row_number() OVER w AS i,
         coalesce(CASE WHEN lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END, 0) AS returns,
         coalesce(CASE WHEN lag(close) OVER w > 0 AND close > 0 THEN ln(close / lag(close) OVER w) END, 0) AS log_returns
  FROM counted WHERE n_all >= 60 WINDOW w AS (PARTITION BY symbol ORDER BY date)
)"""

#: Benchmarks of a symbol's sector and of the market.
BENCH = """
sectors AS (SELECT DISTINCT symbol, CAST(CAST(regexp_extract(symbol, '([0-9]+)', 1) AS INT) % 5 AS VARCHAR) AS sector FROM panel
), sector_bench AS (SELECT sector, date, avg(returns) AS sector_return FROM panel JOIN sectors USING (symbol) GROUP BY sector, date
), market_bench AS (SELECT date, avg(returns) AS market_return FROM panel GROUP BY date
)"""

W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


def r(n: int) -> str:
    """A frame of the last n rows of window w."""
    return f"(w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def mean0(x: str, n: int) -> str:
    return f"CASE WHEN i >= {n} THEN sum(coalesce({x}, 0)) OVER {r(n)} / {n} END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) END"


def fixed(x: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"floor(({x}) * {scale} + 0.5) / {scale}"


def at(n: int, x: str) -> str:
    return f"CASE WHEN i >= {n} THEN {x} END"


def select(columns: dict[str, str], keys: tuple[str, ...] = ("symbol", "date"), digits: int | None = None) -> str:
    show = (lambda x: x) if digits is None else (lambda x: fixed(x, digits))
    return ", ".join([*keys, *[f"{show(x)} AS {n}" for n, x in columns.items()]])
