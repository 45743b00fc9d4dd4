"""Whitening of vectors by leading eigenvectors that inertia counts isolate and number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batch, written
from .vectors import sums, unpacked, whole_numbers

EPS = np.finfo(float).eps
#: A diagonal pivot is taken if it is no smaller than this share of the largest other entry (Bunch and Parlett).
PIVOT = (1 + 17**0.5) / 8
#: Vectors that are multiplied at once.
TOGETHER = 4096
#: A component whose eigenvalue is no larger than this share of the trace has no whitened values.
LEAST = 1e-12


def below(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix a lie below the shift: the negative pivots of an LDLᵀ factorisation of a - shift (Sylvester).

    Pivots are single or in pairs, the largest first; a pair has one negative eigenvalue.
    """
    s, count = a - shift * np.eye(len(a)), 0
    while len(s):
        own = np.abs(np.diag(s))
        other = np.abs(s)
        np.fill_diagonal(other, 0)
        p = int(own.argmax())
        if own[p] >= PIVOT * other.max():
            if own[p] == 0:
                break
            at = [p]
            count += bool(s[p, p] < 0)
        else:
            at = list(np.unravel_index(int(other.argmax()), other.shape))
            count += 1
        rest = np.delete(np.arange(len(s)), at)
        side = s[np.ix_(rest, at)]
        s = s[np.ix_(rest, rest)] - side @ np.linalg.solve(s[np.ix_(at, at)], side.T)
        s = (s + s.T) / 2
    return count


def isolated(a: np.ndarray, k: int, low: float, high: float, finest: float) -> tuple[float, float]:
    """Bounds between which the k-th largest eigenvalue is alone; or, if others are as near as finest, that near to it."""
    n = len(a)
    at_low, at_high = n - below(a, low), n - below(a, high)
    while high - low > finest and not (at_low == k and at_high == k - 1):
        middle = (low + high) / 2
        above = n - below(a, middle)
        low, high, at_low, at_high = (middle, high, above, at_high) if above >= k else (low, middle, at_low, above)
    return low, high


def iterated(a: np.ndarray, found: list[np.ndarray], low: float, high: float, size: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the middle of the bounds, orthogonal to what was found."""
    n = len(a)
    basis = np.array(found).reshape(-1, n)

    def solved(shift: float, v: np.ndarray) -> np.ndarray:
        for _ in range(3):
            try:
                w = np.linalg.solve(a - shift * np.eye(n), v)
                break
            except np.linalg.LinAlgError:
                shift += EPS * size
        else:
            return v
        for _ in range(2):
            w = w - basis.T @ (basis @ w)
        return w / np.linalg.norm(w)

    v = np.cos(np.arange(1, n + 1) ** 2.0)
    v = v - basis.T @ (basis @ v)
    v = v / np.linalg.norm(v)
    for _ in range(2):
        v = solved((low + high) / 2, v)
    value = v @ a @ v
    for _ in range(12):
        if np.linalg.norm(a @ v - value * v) <= 4 * EPS * size:
            break
        v = solved(value, v)
        value = v @ a @ v
    return float(value), v


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a positive semidefinite matrix, falling, and unit eigenvectors as rows.

    Inertia counts cut the spectrum until an eigenvalue is alone between two bounds,
    Rayleigh quotient iteration from there converges cubically, and two more counts just
    beside its value certify the number. If the iteration left its bounds, these are
    halved and it starts again. Equal eigenvalues share bounds of rounding's width and
    get orthogonal vectors. The largest entry of a vector is positive.
    """
    n, size = len(a), float(np.trace(a))
    if size <= 0:
        return np.zeros(count), np.eye(n)[:count]
    values, rows, margin = [], [], 64 * EPS * size
    for k in range(1, count + 1):
        low, high = -margin, size * (1 + 4 * EPS) + margin
        while True:
            low, high = isolated(a, k, low, high, margin)
            value, v = iterated(a, rows, low, high, size)
            if n - below(a, value - margin) >= k and n - below(a, value + margin) < k or high - low <= margin:
                break
            middle = (low + high) / 2
            low, high = (middle, high) if n - below(a, middle) >= k else (low, middle)
        values.append(value)
        rows.append(v * np.sign(v[np.abs(v).argmax()]))
    return np.array(values), np.array(rows)


def totals(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of the fit vectors and their sum for each component; a row for each component reaches the driver."""
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("s", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(size, np.int64)
        for b in batches:
            n, s = n + b.num_rows, s + unpacked(b.column(0), size).sum(axis=0)
        if n:
            yield batch(schema, np.arange(size, dtype=np.int32), np.full(size, n), s)

    found = {r["at"]: r for r in sums(fit.select("x").mapInArrow(add, "at int, n long, s long"), "at").collect()}
    return (int(found[0]["n"]), [int(found[i]["s"]) for i in range(size)]) if found else (0, [0] * size)


def product(y: np.ndarray) -> np.ndarray:
    """yᵀy of integers, exact: by floating-point products while all sums stay below 2**53."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 2**53:
        return (y.T.astype(float) @ y.astype(float)).astype(np.int64).astype(object)
    if most < 2**31:
        high, low = y >> 16, y & 0xFFFF
        cross = product_of(high, low)
        return product_of(high, high) * 2**32 + (cross + cross.T) * 2**16 + product_of(low, low)
    return y.astype(object).T @ y.astype(object)


def product_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """aᵀb of integers up to 2**16 in blocks of TOGETHER rows at most, exact."""
    return (a.T.astype(float) @ b.astype(float)).astype(np.int64).astype(object)


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance of the fit vectors, divisor n, as the quotients of exact integers.

    Vectors are centred by the rounded mean before they are multiplied; the exact
    remainder of the mean is taken off at the end. Tasks hand on one sum for each pair
    of components, and the driver gets as many rows.
    """
    size = len(total)
    centre = np.array([(2 * t + n) // (2 * n) for t in total], dtype=np.int64)
    i, j = np.triu_indices(size)
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("s", pa.string())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = np.zeros((size, size), dtype=object), 0
        for b in batches:
            y = unpacked(b.column(0), size) - centre
            for at in range(0, len(y), TOGETHER):
                s = s + product(y[at : at + TOGETHER])
            n += len(y)
        if n:
            yield batch(schema, np.arange(len(i), dtype=np.int32), np.full(len(i), n), [str(x) for x in s[i, j].tolist()])

    found = {r["at"]: int(r["s"]) for r in sums(fit.select("x").mapInArrow(add, "at int, n long, s string"), "at").collect()}
    rest = [t - n * int(c) for t, c in zip(total, centre)]
    out = np.zeros((size, size))
    for k, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
        out[p, q] = out[q, p] = (n * found[k] - rest[p] * rest[q]) / (n * n)
    return out


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exact: longs where they fit, Python integers otherwise."""
    most = max(n * (int(np.abs(x).max(initial=0)) + 1), max(map(abs, total), default=0))
    if 2 * most < 2**62:
        return n * x - np.array(total, dtype=np.int64)
    return n * x.astype(object) - np.array(total, dtype=object)


def deviations(c: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows; None where they don't fit a long."""
    if c.dtype != object and int(np.abs(c).max(initial=0)) ** 2 * c.shape[1] < 2**63:
        return (c * c).sum(axis=1).tolist()
    c = c.astype(object)
    return [x if x < 2**63 else None for x in (c * c).sum(axis=1).tolist()]


def identity_error(fit: DataFrame, n: int, total: list[int], weights: np.ndarray) -> float | None:
    """The largest entry, in absolute value, of the whitened fit vectors' covariance minus the identity, over the components that have whitened values."""
    size, count = len(total), len(weights)
    if not count:
        return None
    cells = [(p, q) for p in range(count) for q in range(p + 1)]
    schema = pa.schema([("at", pa.int32()), ("s", pa.float64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, mean = np.zeros((count, count)), np.zeros(count)
        for b in batches:
            w = (centred(unpacked(b.column(0), size), n, total) / n).astype(float) @ weights.T
            moments, mean = moments + w.T @ w, mean + w.sum(axis=0)
        yield batch(schema, np.arange(len(cells) + count, dtype=np.int32), [*(float(moments[c]) for c in cells), *mean.tolist()])

    found = {r["at"]: r["s"] for r in fit.select("x").mapInArrow(add, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    mean = [found[len(cells) + p] / n for p in range(count)]
    return max(abs(found[k] / n - mean[p] * mean[q] - (p == q)) for k, (p, q) in enumerate(cells))


def whitened(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors projected on the leading eigenvectors of their covariance, each direction scaled to variance one.

    Components become floor(scale * component). The fit list is each distinct vector
    once: one shuffle, combined within map tasks, so frequent vectors don't gather. Its
    number, sums and covariance are exact integers from sums made in tasks; the driver
    holds size * size numbers. The rest is a projection of each row.

    Vectors that are null, or that hold a null, a NaN, an infinite component or one of
    vectors.LIMIT / scale or more are left out, as are those of another size than most
    have (the larger size of two as frequent). Rows that repeat an id, and null ids, are
    returned each. An eigenvalue of no more than LEAST of the trace, as of fewer distinct
    vectors than components or of constant ones, gives null in whitened, and identity_error
    is that of the other components; explained is null if the trace is 0. deviation is
    null where it doesn't fit a long. Vectors of fewer components than asked for have as
    many rows as components. Other columns, whatever their names, are not read; an empty
    table gives an empty result.
    Returns id_col, component (from 1), n (fit vectors), deviation (sum of the squares of n * x - S), whitened, explained, identity_error.
    """
    kind = vectors.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("component", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("n", "deviation")]]
    out = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    rows = written(whole_numbers(vectors, scale, None, id_col, vector_col))
    sizes = rows.groupBy(F.octet_length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] // 4 if sizes else 0
    if not size:
        return vectors.sparkSession.createDataFrame([], out)
    rows = rows.filter(F.octet_length("x") == 4 * size)
    fit = written(rows.select("x").distinct())
    n, total = totals(fit, size)
    v = covariance(fit, n, total)
    trace = float(np.trace(v))
    values, axes = leading(v, min(components, size))
    good = values > LEAST * trace
    weights = axes[good] / np.sqrt(values[good])[:, None]
    error = identity_error(fit, n, total, weights)
    count, explained = len(values), [float(e) / trace if trace > 0 else None for e in values]
    arrow = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = centred(unpacked(b.column(1), size), n, total)
            w = np.full((len(c), count), np.nan)
            w[:, good] = (c / n).astype(float) @ weights.T
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(c)), count)))
            values = [np.tile(np.arange(1, count + 1), len(c)), np.full(len(c) * count, n), [d for d in deviations(c) for _ in range(count)], pa.array(w.reshape(-1), from_pandas=True), explained * len(c), [error] * (len(c) * count)]
            yield pa.RecordBatch.from_arrays([ids, *[x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(values, arrow)]], names=out.names)

    return rows.select("id", "x").mapInArrow(project, out)
