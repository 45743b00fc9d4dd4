"""Joins by time (J2-J17): as-of, known-at, after a signal, event windows, snapshots, and price relations between instruments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qpanel.functions.windows import safe_corr


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """J4. left with the latest row of right at or before its time.

    Both sides are united and each left row takes the last right row before it: one
    exchange by key and one sort, linear in the rows, where a range join would make
    all pairs of a key. Right columns come as values; several right rows at one time:
    the one with the largest values.
    """
    r = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_time).alias("_time"), *values).alias("_v"))
    l = left.withColumn("_row", F.struct(*left.columns)).select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), "_row")
    both = r.unionByName(l, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select("_row.*", F.col("_v._time").alias(f"asof_{right_time}"), *[F.col(f"_v.{v}").alias(v) for v in values])


def known_at(decisions: DataFrame, facts: DataFrame, by: Sequence[str], decision_time: str, known_time: str, values: Sequence[str]) -> DataFrame:
    """J5. The latest fact that was known at the decision, whatever date it speaks of."""
    return asof(decisions, facts, by, decision_time, known_time, values)


def bars_after(signals: DataFrame, bars: DataFrame, most: int, key: str = "symbol", signal_time: str = "signal_date") -> DataFrame:
    """J3. The first `most` bars strictly after each signal, numbered from 1 in the column after.

    An as-of join finds the signal's own bar number; the bars wanted then have equal
    keys, so a signal never meets a symbol's whole history.
    """
    at = asof(signals, bars.select(key, "date", F.col("i").alias("_at")), [key], signal_time, "date", ["_at"]).drop("asof_date")
    at = at.withColumn("_at", F.coalesce("_at", F.lit(0)).cast("int"))
    wanted = at.withColumn("after", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("_i", F.col("_at") + F.col("after"))
    later = bars.select(key, F.col("i").alias("_i"), F.col("date").alias("bar_date"), *[F.col(c).alias(f"bar_{c}") for c in ("high", "low", "close")])
    return wanted.join(later, [key, "_i"]).drop("_i", "_at")


def in_event_window(bars: DataFrame, events: DataFrame, before: int, after: int, key: str = "symbol", event_date: str = "event_date") -> DataFrame:
    """J6. bars with in_window: whether an event lies from `after` days ago to `before` days ahead.

    Each event becomes its few dates, so that the join has equal keys only.
    """
    days = events.select(key, F.explode(F.sequence(F.date_sub(event_date, before), F.date_add(event_date, after))).alias("date")).distinct()
    return bars.join(days.withColumn("_hit", F.lit(True)), [key, "date"], "left").withColumn("in_window", F.coalesce("_hit", F.lit(False))).drop("_hit")


def first_match(left: DataFrame, lookup: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """J7. left with the first row of lookup for its key, in the given order."""
    best = lookup.groupBy(key).agg(F.min_by(F.struct(*values), F.struct(order, *values)).alias("_v")).select(key, *[F.col(f"_v.{v}").alias(v) for v in values])
    return left.join(best, key, "left")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """J12. Fields that differ between two versions, with both values as text; rows on one side only show up in every field."""
    a = old.select(*keys, F.struct(*fields).alias("_a"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.struct(*fields).alias("_b"), F.lit(True).alias("_in_new"))
    df = a.join(b, list(keys), "full_outer")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a.{f}").cast("string").alias("old_value"), F.col(f"_b.{f}").cast("string").alias("new_value"), (~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}"))).alias("differs")) for f in fields])
    status = F.when(F.col("_in_new").isNull(), "REMOVED").when(F.col("_in_old").isNull(), "ADDED").otherwise("CHANGED")
    return df.withColumn("status", status).select(*keys, "status", F.explode(pairs).alias("p")).filter(F.col("p.differs") | (F.col("status") != "CHANGED")).select(*keys, "status", "p.field", "p.old_value", "p.new_value")


def pair_spread(panel: DataFrame, pairs: DataFrame, window: int = 60) -> DataFrame:
    """J13. For given pairs (a, b) of symbols, with a < b: hedge ratio of log prices over a window, spread and its z-score."""
    p = panel.select("symbol", "date", F.ln("close").alias("lp"))
    df = pairs.join(p.withColumnsRenamed({"symbol": "a", "lp": "ya"}), "a").join(p.withColumnsRenamed({"symbol": "b", "lp": "yb"}), ["b", "date"])
    order = Window.partitionBy("a", "b").orderBy("date")
    w = order.rowsBetween(-(window - 1), 0)
    full = F.count(F.lit(1)).over(w) >= window
    df = df.withColumn("hedge_ratio", F.when(full & (F.var_pop("yb").over(w) > 0), F.covar_pop("ya", "yb").over(w) / F.var_pop("yb").over(w)))
    df = df.withColumn("spread", F.col("ya") - F.col("hedge_ratio") * F.col("yb"))
    n = F.count("spread").over(w) >= window
    return df.withColumn("spread_z", F.when(n, F.try_divide(F.col("spread") - F.avg("spread").over(w), F.stddev_pop("spread").over(w))))


def cross_venue(quotes: DataFrame, fee: float = 0.001, by: str = "symbol", venue: str = "venue", time: str = "ts", price: str = "price") -> DataFrame:
    """J14. At each time the widest net spread between two venues: the highest price of one over the lowest of another.

    Two ordered aggregates instead of a join of venues with each other.
    """
    df = quotes.groupBy(by, time).agg(F.max_by(venue, F.struct(price, venue)).alias("sell_venue"), F.max(price).alias("sell_price"), F.min_by(venue, F.struct(price, venue)).alias("buy_venue"), F.min(price).alias("buy_price"))
    return df.filter("sell_venue <> buy_venue").withColumn("net_spread", F.col("sell_price") * (1 - fee) / (F.col("buy_price") * (1 + fee)) - 1)


def venue_quotes(quotes: DataFrame, venues: Sequence[str], stale: str = "1 day", by: str = "symbol", venue: str = "venue", time: str = "ts") -> DataFrame:
    """quotes with the latest quote of each venue at or before their time, if no older than stale: an array of (venue, bid, ask).

    A k-way as-of in one sorted pass: each row carries the last quote of every venue. Passes
    run by day, so that a busy symbol is many tasks; what a day begins with comes from the
    last quotes of the days before it, a table of a row for each symbol and day. Quotes of
    one time count in order of their venue; the columns grow with the venues, which are few.
    """
    quote = F.struct(F.col(time).alias("t"), "bid", "ask")
    of = [F.when(F.col(venue) == v, quote) for v in venues]
    q = quotes.withColumn("_day", F.to_date(time))
    ends = q.groupBy(by, "_day").agg(*[F.max_by(c, F.when(c.isNotNull(), F.col(time))).alias(f"_end_{k}") for k, c in enumerate(of)])
    before = Window.partitionBy(by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(by, "_day", *[F.last(f"_end_{k}", ignorenulls=True).over(before).alias(f"_start_{k}") for k in range(len(venues))])
    w = Window.partitionBy(by, "_day").orderBy(time, venue).rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumns({f"_own_{k}": F.last(c, ignorenulls=True).over(w) for k, c in enumerate(of)}).join(starts, [by, "_day"])
    latest = [F.coalesce(f"_own_{k}", f"_start_{k}") for k in range(len(venues))]
    fresh = [F.when(x["t"] >= F.col(time) - F.expr(f"INTERVAL {stale}"), F.struct(F.lit(v).alias("venue"), x["bid"].alias("bid"), x["ask"].alias("ask"))) for v, x in zip(venues, latest)]
    return q.select(*quotes.columns, F.array_compact(F.array(*fresh)).alias("latest"))


def venue_spread(quotes: DataFrame, venues: Sequence[str], fee: float = 0.001, stale: str = "1 day", by: str = "symbol", venue: str = "venue", time: str = "ts") -> DataFrame:
    """J14. At each quote's time the best net spread between two venues: the bid of one, less fees, over the ask of another, with fees.

    Only the two best bids and asks can be part of it, as one venue can't be both sides.
    """
    df = venue_quotes(quotes, venues, stale, by, venue, time)
    bids = F.slice(F.sort_array(F.transform("latest", lambda x: F.struct(x["bid"].alias("bid"), x["venue"].alias("sell_venue"))), asc=False), 1, 2)
    asks = F.slice(F.sort_array(F.transform("latest", lambda x: F.struct(x["ask"].alias("ask"), x["venue"].alias("buy_venue")))), 1, 2)
    net = lambda b, a: F.struct((b["bid"] * (1 - fee) / (a["ask"] * (1 + fee)) - 1).alias("net_spread"), b["sell_venue"].alias("sell_venue"), a["buy_venue"].alias("buy_venue"), b["bid"].alias("bid"), a["ask"].alias("ask"))
    pairs = F.flatten(F.transform(bids, lambda b: F.transform(asks, lambda a: net(b, a))))
    best = F.array_max(F.filter(pairs, lambda p: p["sell_venue"] != p["buy_venue"]))
    return df.withColumn("_best", best).filter("_best IS NOT NULL").select(by, time, "_best.*")


def basket_premium(holdings: DataFrame, prices: DataFrame, fund_prices: DataFrame) -> DataFrame:
    """J15. holdings(fund, symbol, shares), prices(symbol, date, close), fund_prices(fund, date, price): value of a fund's basket and its premium."""
    nav = holdings.join(prices, "symbol").groupBy("fund", "date").agg(F.sum(F.col("shares") * F.col("close")).alias("basket_value"), F.count(F.lit(1)).alias("n_held"))
    return nav.join(fund_prices, ["fund", "date"]).withColumn("premium", F.when(F.col("basket_value") > 0, F.col("price") / F.col("basket_value") - 1))


def carry(spot: DataFrame, futures: DataFrame, rate: float = 0.03) -> DataFrame:
    """J16. spot(underlying, date, spot_price), futures(underlying, date, future_price, expiry): basis, fair basis and the annual mispricing."""
    df = spot.join(futures, ["underlying", "date"])
    years = F.date_diff("expiry", "date") / 365.0
    df = df.withColumn("years", years).filter("years > 0 AND spot_price > 0 AND future_price > 0")
    df = df.withColumn("basis", F.col("future_price") / F.col("spot_price") - 1).withColumn("fair_basis", F.exp(F.lit(rate) * F.col("years")) - 1)
    return df.withColumn("annual_carry", F.ln(F.col("future_price") / F.col("spot_price")) / F.col("years")).withColumn("mispricing", F.col("annual_carry") - rate)


def triangles(rates: DataFrame, fee: float = 0.0005) -> DataFrame:
    """J17. rates(base, quote, ts, rate): the product around each three-currency circle, net of fees; each circle once, from its smallest currency."""
    a = rates.select(F.col("base").alias("c1"), F.col("quote").alias("c2"), "ts", F.col("rate").alias("r1"))
    b = rates.select(F.col("base").alias("c2"), F.col("quote").alias("c3"), "ts", F.col("rate").alias("r2"))
    c = rates.select(F.col("base").alias("c3"), F.col("quote").alias("c1"), "ts", F.col("rate").alias("r3"))
    df = a.join(b, ["c2", "ts"]).filter("c1 < c2 AND c1 < c3 AND c2 <> c3").join(c, ["c3", "c1", "ts"])
    return df.withColumn("net_product", F.col("r1") * F.col("r2") * F.col("r3") * F.pow(F.lit(1 - fee), F.lit(3))).withColumn("profitable", F.col("net_product") > 1)


def rolling_pair_correlation(panel: DataFrame, window: int = 60) -> DataFrame:
    """A36. Trailing correlation of the returns of all pairs a < b of symbols on a date, with a flag for a jump against its own mean.

    The join is on date: pairs grow with the square of a date's symbols, which is the result itself.
    """
    p = panel.select("date", "symbol", "returns")
    df = p.withColumnsRenamed({"symbol": "a", "returns": "ra"}).join(p.withColumnsRenamed({"symbol": "b", "returns": "rb"}), "date").filter("a < b")
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(-(window - 1), 0)
    return df.withColumn("corr", F.when(F.count(F.lit(1)).over(w) >= window, safe_corr(F.col("ra"), F.col("rb"), w))).withColumn("spike", F.abs("corr") >= 0.5)


def pair_correlations(panel: DataFrame, window: int = 60, blocks: int = 8, candidates: float = 0.0) -> DataFrame:
    """A36. Trailing correlation of the returns of all pairs a < b of symbols over their common dates: (a, b, date, corr), from the date on that fills the window.

    Symbols fall into blocks, and each task holds two blocks: a bar goes to as many tasks
    as there are blocks, not as there are other symbols, and dates are lined up once for
    a tile instead of once for a pair. With candidates above 0, pairs whose correlation
    over all their dates is smaller in absolute value are left out before any window.
    More blocks make smaller tiles.
    """
    side = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    rows = panel.filter("returns IS NOT NULL").select("symbol", "date", "returns", side.alias("_own"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = rows.withColumn("_other", other).select("symbol", "date", "returns", F.least("_own", "_other").alias("_p"), F.greatest("_own", "_other").alias("_q"), "_own")

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        dates, day = np.unique(frame["date"].to_numpy(), return_inverse=True)
        names, at = np.unique(frame["symbol"].to_numpy(dtype=str), return_inverse=True)
        x = np.full((len(names), len(dates)), np.nan)
        x[at, day] = frame["returns"].to_numpy(dtype=float)
        own = np.empty(len(names), dtype=int)
        own[at] = frame["_own"].to_numpy()
        same, out = frame["_p"].iat[0] == frame["_q"].iat[0], []
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                if not same and own[i] == own[j]:
                    continue
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                a, b = x[i, both], x[j, both]
                if len(a) < window or candidates > 0 and not abs(correlated(a[None], b[None])[0]) >= candidates:
                    continue
                r = correlated(np.lib.stride_tricks.sliding_window_view(a, window), np.lib.stride_tricks.sliding_window_view(b, window))
                out.append(pd.DataFrame({"a": names[i], "b": names[j], "date": dates[both][window - 1 :], "corr": r}))
        if not out:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("a", "b", "date", "corr")})
        found = pd.concat(out, ignore_index=True)
        found["corr"] = found["corr"].astype(object).where(~found["corr"].isna(), None)
        return found

    return rows.groupBy("_p", "_q").applyInPandas(tile, "a string, b string, date date, corr double")


def correlated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of each row of a with that of b; NaN without variance."""
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        return np.where(d > 0, (a * b).sum(axis=1) / d, np.nan)


def correlation_regimes(correlations: DataFrame, panel: DataFrame, history: int = 60, width: float = 3.0, vol_window: int = 20) -> DataFrame:
    """A36. correlations with spike, a jump of more than width deviations from the pair's own last history values, and the volatility regime of the date.

    The regime is high where the market's volatility over vol_window dates is above the
    median of its own history up to that date; a row for each date, which is one small
    series, so it has one window over all dates.
    """
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(-history, -1)
    full = F.count("corr").over(w) >= history
    spike = F.abs(F.col("corr") - F.avg("corr").over(w)) > width * F.stddev_pop("corr").over(w)
    days = Window.partitionBy(F.lit(0)).orderBy("date")
    market = panel.groupBy("date").agg(F.avg("returns").alias("m")).withColumn("_vol", F.when(F.count("m").over(days.rowsBetween(-(vol_window - 1), 0)) >= vol_window, F.stddev_pop("m").over(days.rowsBetween(-(vol_window - 1), 0))))
    median = F.percentile("_vol", 0.5).over(days.rowsBetween(Window.unboundedPreceding, 0))
    market = market.select("date", F.when(F.col("_vol") > median, "high").when(F.col("_vol").isNotNull(), "low").alias("regime"))
    return correlations.withColumn("spike", F.when(full, spike)).join(market, "date")
