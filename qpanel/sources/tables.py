"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """A new folder below the one that all executors reach; a local one only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="qpanel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/store-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as a table that is computed once, however often it is read, and outlives lost executors."""
    path = shared_root(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
