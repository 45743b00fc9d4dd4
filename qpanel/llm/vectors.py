"""Vectors of floating-point numbers as exact integers, and what the vector operators have in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integers of this size or more are taken like infinite ones: below it, sums of squares of differences of 64 components fit a long.
LIMIT = 2**27
SIGN = np.uint32(0x80000000)


def packed(x: np.ndarray) -> np.ndarray:
    """Rows of integers as bytes whose order is that of the components: four bytes each, big-endian, with the sign bit turned."""
    return (x.astype(np.int32).view(np.uint32) ^ SIGN).astype(">u4")


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    """A column of packed vectors of size components as rows of longs."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=">u4").astype(np.uint32)
    return (raw ^ SIGN).view(np.int32).astype(np.int64).reshape(-1, size)


def binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())]).cast(pa.binary())


def whole_numbers(df: DataFrame, scale: int, size: int | None, id_col: str, vector_col: str) -> DataFrame:
    """id and x: the packed floor(scale * component) of each vector.

    Left out are null vectors, those that hold a null, a NaN or an infinite component,
    those with an integer of LIMIT or more, and, where size is given, those of other sizes.
    """
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            lengths = np.asarray(v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int64)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * flat) + 0.0
                bad = ~(np.abs(x) < LIMIT)
            ends = np.cumsum(np.maximum(lengths, 0))
            wrong = np.r_[0, np.cumsum(bad)]
            keep = (lengths >= 0) & (wrong[ends] == wrong[ends - np.maximum(lengths, 0)])
            if size is not None:
                keep &= lengths == size
            for n in np.unique(lengths[keep]):
                at = np.flatnonzero(keep & (lengths == n))
                own = x[(ends[at] - n)[:, None] + np.arange(n)].astype(np.int64)
                column = binary(packed(own)) if n else pa.array([b""] * len(at), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), column], names=["id", "x"])

    return rows.mapInArrow(convert, T.StructType([T.StructField("id", kind), T.StructField("x", T.BinaryType())]))


def sums(df: DataFrame, *keys: str) -> DataFrame:
    """n and s, exact sums by keys: tasks hand on one row for each key, of longs or of numbers as text."""
    return df.groupBy(*keys).agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
