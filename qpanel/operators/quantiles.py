"""Exact ranks and quantiles of large groups: no group is sorted or held whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qpanel.sources.tables import settled

#: Parts that a group is cut into; a task sorts one part.
PARTS = 64


def in_parts(df: DataFrame, by: Sequence[str], x: str, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """df with _part, which grows with x within a group, and for each part its rows _n, those before it _from, and those of the group _total.

    Parts lie between approximate quantiles, which are merged within map tasks and
    settled, as they may differ from run to run. Groups are those of a report, so their
    bounds and counts are small enough to be broadcast. Values of x aren't null.
    """
    cuts = settled(df.groupBy(*by).agg(F.percentile_approx(x, [k / parts for k in range(1, parts)], 1000).alias("_cuts")))
    dealt = df.join(F.broadcast(cuts), list(by)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(x)))).drop("_cuts")
    counts = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    return dealt, counts.withColumns({"_from": upto - F.col("_n"), "_total": F.sum("_n").over(group)})


def tiles(df: DataFrame, by: Sequence[str], x: str, ties: Sequence[str], n: int = 10, name: str = "tile") -> DataFrame:
    """df with the number of its n-tile, as ntile() over the group in order of x and ties gives it."""
    dealt, counts = in_parts(df, by, x)
    w = Window.partitionBy(*by, "_part").orderBy(x, *ties)
    rows = dealt.join(F.broadcast(counts), [*by, "_part"]).withColumn("_row", F.col("_from") + F.row_number().over(w) - 1)
    # the first _over tiles have a row more than the others
    size, over = F.floor(F.col("_total") / n), F.col("_total") % n
    longer = over * (size + 1)
    tile = F.when(F.col("_row") < longer, F.floor(F.col("_row") / (size + 1))).otherwise(over + F.floor((F.col("_row") - longer) / size))
    return rows.withColumn(name, (tile + 1).cast("int")).drop("_part", "_n", "_from", "_total", "_row")


def quantiles(df: DataFrame, by: Sequence[str], x: str, shares: Sequence[float], name: str = "q") -> DataFrame:
    """The by columns and an array of exact quantiles, as percentile() interpolates them, of the values of x that are present.

    Only the parts that hold a quantile are looked at again, as counts of distinct values.
    """
    by = list(by)
    dealt, counts = in_parts(df.filter(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x")), by, "_x")
    place = [s * (F.col("_total") - 1) for s in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place for f in (F.floor, F.ceil)]))
    held = counts.withColumn("_rank", F.explode(ranks)).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n")))
    wanted = held.groupBy(*by, "_part", "_from", "_total").agg(F.collect_list("_rank").alias("_ranks"))
    seen = dealt.join(F.broadcast(wanted), [*by, "_part"]).groupBy(*by, "_part", "_from", "_total", "_ranks", "_x").agg(F.count(F.lit(1)).alias("_c"))
    end = F.col("_from") + F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    met = seen.withColumn("_end", end).withColumn("_rank", F.explode("_ranks")).filter((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c")))
    values = met.groupBy(*by, "_total").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_v"))

    def interpolated(p):
        low, high = F.col("_v")[F.floor(p).cast("long")], F.col("_v")[F.ceil(p).cast("long")]
        return F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return values.select(*by, F.array(*[interpolated(p) for p in place]).alias(name))
