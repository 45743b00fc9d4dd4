"""Connected components of a graph too large for one task, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def hooked(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: each node's neighbours on one side are hung on its smallest neighbour.

    Reducing to the smallest neighbour combines within map tasks, and the join back has
    one small row per node on its other side, so a node with very many neighbours can
    be split between tasks.
    """
    if larger:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = pairs.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hung.filter("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b), a > b, of longs: each node that has an edge, with the smallest node of its component.

    Large-star and small-star steps alternate, each round a table in the shared folder,
    until a round changes nothing; then every edge leads to its component's smallest
    node. The number of rounds grows with the logarithm of a component's diameter.
    Returns (node, root); roots are not listed themselves.
    """
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    edges = written(edges.filter("a > b").distinct())
    before = edges.select(mark.alias("m")).first()["m"]
    for _ in range(rounds):
        if before["n"] == 0:
            break
        edges = written(hooked(hooked(edges, True), False))
        now = edges.select(mark.alias("m")).first()["m"]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
