"""Centroid clustering on exact integers, with dot products that are kept and mended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batch, removed, table_path, written
from .vectors import LIMIT, binary, sums, unpacked, whole_numbers


def mended(dots: np.ndarray, x: np.ndarray, before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """dots, the products of the rows of x with the centroids before, as those with the centroids now: only components that changed are multiplied."""
    dots = dots.copy()
    for k, change in enumerate(now - before):
        at = np.flatnonzero(change)
        if len(at):
            dots[:, k] += x[:, at] @ change[at]
    return dots


def nearest(dots: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; the smaller number among equals."""
    distances = (x * x).sum(axis=1)[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)[None, :]
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(x)), best]


def started(vectors: DataFrame, k: int, seed: str, size: int) -> np.ndarray:
    """The k vectors whose ids have the smallest digests; null ids come last, equal ones by their vectors."""
    rows = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).select("x").collect()
    return unpacked(pa.array([bytes(r["x"]) for r in rows], pa.binary()), size)


def moved(state: DataFrame, centroids: np.ndarray, size: int) -> np.ndarray:
    """Each centroid as the exact floor of the mean of its vectors; one without vectors stays.

    Tasks hand on one sum for each centroid and component; the driver gets as many rows.
    """
    k = len(centroids)
    schema = pa.schema([("cluster", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("s", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            x, cluster = unpacked(b.column(0), size), b.column(1).to_numpy()
            n += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            if len(found):
                s[found] += np.add.reduceat(x[order], first, axis=0)
        at = np.flatnonzero(n)
        yield batch(schema, np.repeat(at, size), np.tile(np.arange(size), len(at)), np.repeat(n[at], size), s[at].reshape(-1))

    out = centroids.copy()
    for r in sums(state.select("x", "cluster").mapInArrow(add, "cluster int, at int, n long, s long"), "cluster", "at").collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // int(r["n"])
    return out


def step(state: DataFrame, before: np.ndarray, now: np.ndarray, last: bool) -> DataFrame:
    """The state (id, x, dots, cluster) for the centroids now; at last only id, cluster and distance.

    A state without dots has those of centroids at zero, so the first products are changes as well.
    """
    (k, size), first = now.shape, "dots" not in state.columns
    kind = state.schema["id"]
    kept = [T.StructField("x", T.BinaryType()), T.StructField("dots", T.BinaryType()), T.StructField("cluster", T.IntegerType())]
    ends = [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpacked(b.column(1), size)
            old = np.zeros((len(x), k), np.int64) if first else np.frombuffer(b"".join(b.column(2).to_pylist()), dtype="<i8").reshape(-1, k)
            dots = mended(old, x, before, now)
            best, distance = nearest(dots, x, now)
            cluster = pa.array(best.astype(np.int32))
            if last:
                yield pa.RecordBatch.from_arrays([b.column(0), cluster, pa.array(distance)], names=["id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binary(dots.astype("<i8")), cluster], names=["id", "x", "dots", "cluster"])

    return state.select(*(["id", "x"] if first else ["id", "x", "dots"])).mapInArrow(update, T.StructType([kind, *(ends if last else kept)]))


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors assigned to k centroids that are moved for a number of rounds, all in exact integers.

    Components become floor(scale * component). The dot products of each vector with all
    centroids are part of a table in the shared folder; a round adds the products with
    the components of a centroid that changed, and nothing for those that did not, then
    takes the nearest centroid anew. Each round's table replaces the one before it, so
    two of them exist at most. The driver holds k * size numbers.

    Vectors that are null, of another size, or that hold a null, a NaN, an infinite
    component or one of LIMIT / scale or more are left out. Rows that repeat an id are
    assigned each, and may start a centroid each; null ids stay, and start centroids
    only where no others are left. Fewer than k vectors give fewer centroids. Other
    columns, whatever their names, are not read; an empty table gives an empty result.
    Returns id_col, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256 (of the final components in decimal, joined by commas).
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, scale, size, id_col, vector_col)
    now = started(rows, k, seed, size)
    if not len(now):
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    before, state, path = np.zeros_like(now), rows, None
    for _ in range(rounds):
        state, old, path = written(step(state, before, now, last=False), new := table_path(spark)), path, new
        if old:
            removed(spark, old)
        before, now = now, moved(state, now, size)
    found = written(step(state, before, now, last=True))
    if path:
        removed(spark, path)
    # one row for each centroid
    digests = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(now)]
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in inertia)
    sizes = {r["cluster"]: r["cluster_inertia"] for r in inertia}
    report = spark.createDataFrame([(j, sizes.get(j, 0), total, d) for j, d in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(report), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1") -> str:
    """clustered() of the table embeddings as DuckDB SQL: all distances of each round, from nothing that was kept."""
    text = f"""
WITH kept AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(floor({scale} * x::DOUBLE)) < {LIMIT})) = {size}
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS BIGINT) AS j, v
  FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k})
)"""
    for r in range(rounds + 1):
        text += f""", a{r} AS (
  SELECT t.rn, any_value(t.vec_id) AS vec_id, any_value(t.v) AS v,
         min(CAST(list_sum(list_transform(list_zip(t.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) * {k} + c.j) AS m
  FROM kept t CROSS JOIN c{r} c GROUP BY t.rn
)"""
        if r < rounds:
            text += f""", s{r} AS (
  SELECT m % {k} AS j, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {size + 1}) g(i) GROUP BY ALL
), m{r} AS (
  SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY j
), c{r + 1} AS (
  SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.j = m.j
)"""
    return (
        text
        + f"""
SELECT vec_id, CAST(c.j AS INTEGER) AS cluster, m // {k} AS distance, CAST(sum(m // {k}) OVER (PARTITION BY c.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.m % {k} = c.j
"""
    )
