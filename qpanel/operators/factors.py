"""Residuals to principal components of a panel with any number of symbols."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qpanel.sources.tables import settled

#: Vectors that are iterated beside those asked for, the largest residual of an eigenpair by the first eigenvalue, and most rounds.
GUARDS, PRECISION, ROUNDS = 9, 1e-9, 200
#: Directions whose share of the basis is below this are not independent.
DEPENDENT = 1e-11
#: Residuals, by the first eigenvalue, below which an eigenpair is left as it is.
SETTLED = PRECISION / 4


def centred(bars: DataFrame) -> DataFrame:
    """symbol, date and x, the return less the symbol's mean; missing returns, which count as the mean, have no row."""
    df = bars.select("symbol", "date", F.col("returns").cast("double").alias("x")).filter(F.col("x").isNotNull() & (F.abs("x") < float("inf")))
    return df.join(df.groupBy("symbol").agg(F.avg("x").alias("mean")), "symbol").select("symbol", "date", (F.col("x") - F.col("mean")).alias("x"))


def scores(entries: DataFrame, vectors: DataFrame, m: int) -> DataFrame:
    """X V: date and y, for vectors (symbol, v); sums are combined within map tasks."""
    sums = [F.sum(F.col("x") * F.col("v")[j]).alias(f"_{j}") for j in range(m)]
    return entries.join(vectors, "symbol").groupBy("date").agg(*sums).select("date", F.array(*[f"_{j}" for j in range(m)]).alias("y"))


def multiplied(entries: DataFrame, vectors: DataFrame, m: int) -> DataFrame:
    """Xᵀ(X V), symbol and w: the covariance times the vectors, without a covariance."""
    sums = [F.sum(F.col("x") * F.col("y")[j]).alias(f"_{j}") for j in range(m)]
    return entries.join(scores(entries, vectors, m), "date").groupBy("symbol").agg(*sums).select("symbol", F.array(*[f"_{j}" for j in range(m)]).alias("w"))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def products(basis: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """ZᵀZ and ZᵀCZ of a basis (symbol, z, c): width x width numbers, summed within tasks, then over tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width, width))
        for b in batches:
            z, c = matrix(b.column(0)), matrix(b.column(1))
            total += np.stack([z.T @ z, z.T @ c])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["sums"])

    rows = basis.select("z", "c").mapInArrow(partial, "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    total = np.zeros(2 * width * width)
    for r in rows:
        total[r["pos"]] = r["s"]
    g, a = total.reshape(2, width, width)
    return g, (a + a.T) / 2


def best(g: np.ndarray, a: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the m orthonormal vectors in the basis with the largest Rayleigh quotients, and these; zero columns where it has fewer."""
    size = np.sqrt(np.diag(g))
    # pairs that have settled give no new direction: scaled up, their residuals would be rounding only
    used = size > 0
    unsettled = size[m : 2 * m] > SETTLED
    used[m:] &= np.tile(unsettled, 2)
    scale = np.where(used, 1 / np.where(used, size, 1.0), 0.0)
    w, u = np.linalg.eigh(g * np.outer(scale, scale))
    t = scale[:, None] * u[:, w > DEPENDENT * w[-1]] / np.sqrt(w[w > DEPENDENT * w[-1]]) if w[-1] > 0 else np.zeros((len(g), 0))
    theta, s = np.linalg.eigh(t.T @ a @ t)
    take = np.argsort(-theta)[:m]
    b, values = np.zeros((len(g), m)), np.zeros(m)
    b[:, : len(take)], values[: len(take)] = t @ s[:, take], theta[take]
    return b, values


def turned(basis: DataFrame, b: np.ndarray, theta: np.ndarray) -> DataFrame:
    """The basis of the next round but for the residuals' products: symbol, v, cv, r (by the first eigenvalue), p, cp."""
    m = b.shape[1]
    rest = b.copy()
    rest[:m] = 0.0
    unit = theta[0] if theta[0] > 0 else 1.0
    schema = "symbol string, v array<double>, cv array<double>, r array<double>, p array<double>, cp array<double>"

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            z, c = matrix(x.column(1)), matrix(x.column(2))
            v, cv = z @ b, c @ b
            parts = [v, cv, (cv - v * theta) / unit, z @ rest, c @ rest]
            yield pa.RecordBatch.from_arrays([x.column(0), *[pa.array(list(q), pa.list_(pa.float64())) for q in parts]], names=["symbol", "v", "cv", "r", "p", "cp"])

    return basis.select(F.col("symbol").cast("string").alias("symbol"), "z", "c").mapInArrow(turn, schema)


def leading(entries: DataFrame, k: int, guards: int = GUARDS, rounds: int = ROUNDS) -> DataFrame:
    """The k leading eigenvectors of the symbols x symbols covariance: symbol, v (array of k; zeros beyond its rank).

    Blocks of vectors are iterated together: each round takes the best ones of the span
    of the block, its residuals and its last step, so one product with the covariance,
    which is two sums over the entries, serves a round. Vectors are rows of a table with
    one row a symbol; only (3 (k + guards))**2 sums reach the driver. Ends when the
    residuals of all k eigenpairs are PRECISION of the first eigenvalue.
    """
    m = k + guards
    nothing = F.array_repeat(F.lit(0.0), m)
    # a start that depends on nothing but the symbols
    start = F.array(*[F.xxhash64("symbol", F.lit(j)) / F.lit(2.0**63) for j in range(m)])
    v = settled(entries.select("symbol").distinct().select("symbol", start.alias("v")))
    basis = v.join(multiplied(entries, v, m), "symbol").select("symbol", F.concat("v", nothing, nothing).alias("z"), F.concat("w", nothing, nothing).alias("c"))
    theta = None
    for _ in range(rounds):
        basis = settled(basis)
        g, a = products(basis, 3 * m)
        if theta is not None and np.sqrt(np.diag(g)[m : m + k]).max() <= PRECISION:
            return basis.select("symbol", F.slice("z", 1, k).alias("v"))
        b, theta = best(g, a, m)
        block = settled(turned(basis, b, theta))
        w = multiplied(entries, block.select("symbol", F.col("r").alias("v")), m)
        basis = block.join(w, "symbol").select("symbol", F.concat("v", "r", "p").alias("z"), F.concat("cv", "w", "cp").alias("c"))
    raise RuntimeError(f"eigenvectors did not settle in {rounds} rounds")


def factor_residuals(bars: DataFrame, k: int = 3) -> DataFrame:
    """W48. Returns of each bar, less the symbol's mean, without their projection on the first k principal components.

    A symbol's missing returns count as its mean. Bars without a finite return have a
    null residual; with k symbols or fewer nothing is left but zeros. No matrix is ever
    laid out: neither a column per symbol nor a covariance. Where tables of vectors and
    scores are small, Catalyst broadcasts them by their sizes on disk.
    Returns symbol, date, factor_residual.
    """
    entries = settled(centred(bars.withColumn("symbol", F.col("symbol").cast("string"))))
    v = settled(leading(entries, k))
    y = settled(scores(entries, v, k))
    fitted = sum((F.col("v")[j] * F.col("y")[j] for j in range(k)), F.lit(0.0))
    found = entries.join(v, "symbol").join(y, "date").select("symbol", "date", (F.col("x") - fitted).alias("factor_residual"))
    return bars.select(F.col("symbol").cast("string").alias("symbol"), "date").join(found, ["symbol", "date"], "left")
