"""What the document operators have in common: shared tables, Arrow maps, text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="qpanel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def table_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/qpanel-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts its lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = path or table_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no result reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread_join(many: DataFrame, one: DataFrame, key: str, most: int = 200_000) -> DataFrame:
    """many with the columns of one, which has each key once at most.

    Keys with more than most rows of many are dealt to several tasks; the table of them,
    which is broadcast, has no more than rows / most rows of a key and a number.
    """
    busy = written(many.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")).filter("_parts > 1"))
    if busy.isEmpty():
        return many.join(one, key)
    busy = F.broadcast(busy)
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_parts", F.lit(1))).cast("int")
    left = many.join(busy, key, "left").withColumn("_part", deal).drop("_parts")
    right = one.join(busy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
