"""The registered queries of the panel engine and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel.operators import labels

from . import features, labels_joins, live, reports, scores

MODULES = (features, labels_joins, scores, reports, live)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and mean forward return by bucket of the 20-bar z-score: bars, features, labels and an event study in one plan."""
    df = labels.forward_returns(features.features(spark, sf_dir, ["sma_20", "zscore_20d", "mom_20d"]), (5,))
    bucket = F.when(F.col("zscore_20d") <= -1, "low").when(F.col("zscore_20d") >= 1, "high").otherwise("middle")
    df = df.filter("zscore_20d IS NOT NULL AND forward_return_5d IS NOT NULL").groupBy(bucket.alias("bucket"))
    return df.agg(F.count("forward_return_5d").alias("n"), F.avg("forward_return_5d").alias("mean_return"), F.avg((F.col("forward_return_5d") > 0).cast("double")).alias("hit_rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
