"""The versioned feature store (S8-S18): Parquet partitioned by version and category, with a manifest and a catalog."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG = "symbol string, date date, feature string, value double, version string, category string"
MANIFEST = "version string, created timestamp, n_rows long, n_symbols long"
CATALOG = "symbol string, category string, feature string, n_values long, n_nan long, mean double, std double, quantiles binary, distincts binary, version string"


class FeatureStore:
    """Features in long form below one folder, which all executors reach.

    A version is written once; writing it again replaces just its partitions. The
    catalog holds each feature's statistics by symbol (never the last symbol's only).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def write(self, wide: DataFrame, categories: dict[str, str], version: str, keys: Sequence[str] = ("symbol", "date")) -> None:
        """S8. wide(symbol, date, features) as one version; categories maps each feature to its category."""
        names = list(categories)
        long = wide.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(list(keys), names, "feature", "value")
        kind = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])
        long = long.withColumns({"version": F.lit(version), "category": kind[F.col("feature")]})
        # one file per category and task: rows of a symbol stay together
        long.repartition("category", "symbol").sortWithinPartitions("feature", "symbol", "date").write.partitionBy("version", "category").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/features")
        saved = self._read("features", LONG).filter(F.col("version") == version)
        stats = saved.groupBy("symbol", "category", "feature").agg(F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("value").isNull()).alias("n_nan"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.kll_sketch_agg_double("value").alias("quantiles"), F.hll_sketch_agg(F.col("value").cast("string")).alias("distincts"))
        stats.withColumn("version", F.lit(version)).write.partitionBy("version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/catalog")
        row = wide.agg(F.lit(version).alias("version"), F.current_timestamp().alias("created"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def versions(self) -> DataFrame:
        """S10."""
        return self._read("manifest", MANIFEST).groupBy("version").agg(F.max("created").alias("created"), F.max_by("n_rows", "created").alias("n_rows"), F.max_by("n_symbols", "created").alias("n_symbols"))

    def latest(self) -> str | None:
        row = self.versions().agg(F.max_by("version", "created")).first()
        return row[0] if row else None

    def read(self, symbols: Sequence[str] | None = None, version: str = "latest", features: Sequence[str] | None = None) -> DataFrame:
        """S9. Long rows of a version; an unknown version gives none. Only its partitions are read."""
        v = self.latest() if version == "latest" else version
        df = self._read("features", LONG).filter(F.col("version") == F.lit(v))
        if symbols is not None:
            df = df.filter(F.col("symbol").isin(list(symbols)))
        return df.filter(F.col("feature").isin(list(features))) if features is not None else df

    def matrix(self, features: Sequence[str], symbols: Sequence[str] | None = None, version: str = "latest") -> DataFrame:
        """S14, S15, O11. (symbol, date) rows with the named features as columns and as one array."""
        df = self.read(symbols, version, features).groupBy("symbol", "date").pivot("feature", list(features)).agg(F.first("value"))
        return df.withColumn("vector", F.array(*[F.col(f) for f in features]))

    def at(self, symbol: str, when: str, features: Sequence[str] | None = None, version: str = "latest") -> DataFrame:
        """S13. Each feature's last value at or before a date."""
        df = self.read([symbol], version, features).filter((F.col("date") <= F.to_date(F.lit(when))) & F.col("value").isNotNull())
        return df.groupBy("feature").agg(F.max_by("value", "date").alias("value"), F.max("date").alias("date"))

    def catalog(self, features: Sequence[str] | None = None, fqn: str | None = None, version: str | None = None) -> DataFrame:
        """S11. Catalog rows by name, or by version/symbol/category/feature."""
        df = self._read("catalog", CATALOG).withColumn("fqn", F.concat_ws("/", "version", "symbol", "category", "feature"))
        if version is not None:
            df = df.filter(F.col("version") == version)
        if fqn is not None:
            df = df.filter(F.col("fqn") == fqn)
        return df.filter(F.col("feature").isin(list(features))) if features is not None else df

    def distributions(self, probabilities: Sequence[float] = (0.05, 0.5, 0.95), versions: Sequence[str] | None = None, by: Sequence[str] = ("feature",)) -> DataFrame:
        """S11, O7. Percentiles and numbers of distinct values of any set of versions and symbols, merged from the catalog's sketches: no value is read again.

        Ranks of percentiles are off by 1.65 % at most with a confidence of 99 %, numbers of distinct values by some 1.6 % (a deviation).
        """
        c = self.catalog() if versions is None else self.catalog().filter(F.col("version").isin(list(versions)))
        c = c.groupBy(*by).agg(F.sum("n_values").alias("n_values"), F.sum("n_nan").alias("n_nan"), F.kll_merge_agg_double("quantiles").alias("_q"), F.hll_union_agg("distincts").alias("_d"))
        at = F.when(F.col("n_values") > F.col("n_nan"), F.kll_sketch_get_quantile_double("_q", F.array(*[F.lit(float(p)) for p in probabilities])))
        return c.select(*by, "n_values", "n_nan", F.hll_sketch_estimate("_d").alias("n_distinct"), at.alias("percentiles"))

    def summary(self, version: str = "latest") -> DataFrame:
        """S12. Features and rows of each category."""
        v = self.latest() if version == "latest" else version
        return self.catalog(version=v).groupBy("category").agg(F.countDistinct("feature").alias("n_features"), F.sum("n_values").alias("n_values"))

    def cache(self, df: DataFrame, name: str, buckets: int = 8) -> DataFrame:
        """S18. A table bucketed and sorted by symbol, which later joins and windows by symbol read without a shuffle."""
        df.write.bucketBy(buckets, "symbol").sortBy("symbol", "date").mode("overwrite").option("path", f"{self.root}/cache/{name}").saveAsTable(name)
        return self.spark.table(name)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "csv") -> DataFrame:
    """S16. A CSV or JSON ledger with a fixed schema; a bad row keeps its text in _corrupt_record; a missing file gives no rows."""
    from pyspark.errors import AnalysisException

    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    try:
        return reader.option("header", True).csv(path) if form == "csv" else reader.json(path)
    except AnalysisException:
        return spark.createDataFrame([], full)


def write_report(df: DataFrame, path: str, run_id: str) -> None:
    """S17. A report's rows as JSON below its run's folder; a run written again replaces itself."""
    df.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def registry(spark: SparkSession, specs: Sequence) -> DataFrame:
    """The feature registry, made from the specifications that actually run."""
    schema = "feature string, category string, lookback int, input_data array<string>, known_at_time string, lag_required int, point_in_time_safe boolean, version string"
    return spark.createDataFrame([(s.name, s.category, s.lookback, list(s.inputs), "close", 0, True, "1") for s in specs if not s.name.startswith("_")], schema)


#: Metadata of each feature as it is registered, independent of the specifications that compute it. Fixed values.
REGISTERED = Path(__file__).with_name("feature_registry.csv")
REGISTRY = "feature string, category string, inputs array<string>, lookback int, known_at_time string, lag_required int, point_in_time_safe boolean, missing_policy string, max_nan_after_warmup double"


def loaded_registry(spark: SparkSession, path: str | Path = REGISTERED) -> DataFrame:
    """The registered metadata; read on the driver, as executors don't have the package's folder. A row for each feature."""
    with open(path, newline="") as f:
        rows = [
            (r["feature"], r["category"], r["inputs"].split(), int(r["lookback"]) if r["lookback"] else None, r["known_at_time"], int(r["lag_required"]), r["point_in_time_safe"] == "true", r["missing_policy"], float(r["max_nan_after_warmup"] or 0.05))
            for r in csv.DictReader(f)
        ]
    return spark.createDataFrame(rows, REGISTRY)
