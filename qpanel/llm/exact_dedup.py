"""Exact deduplication by a content sort, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_or_empty, written

#: No more than this many groups are treated as hot, with no more bytes of text in sum; larger ones first.
MOST_HOT, HOT_BYTES = 4096, 64_000_000
#: Bytes of text that the range splitters see, besides the hash of the whole text.
LEAD = 16


def content_sort(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] = lambda text: text,
    carry: bool = False,
) -> DataFrame:
    """Groups of equal texts: one row per input row.

    Rows are range-partitioned at sampled splitters and sorted outside memory by the
    start of the text, the hash of all of it, and the whole text, so that equal texts
    lie side by side and neighbours are compared in full. The splitters are short
    (LEAD characters and a hash), so that the sample does not grow with the texts.

    A group that holds more than 1/partitions of all rows would overload one range.
    There are fewer than ``partitions`` such groups. As long as their texts have
    HOT_BYTES in sum (groups beyond that are sorted like others), they are reduced
    within the map tasks, and the few results broadcast; their rows are never shuffled.
    Of a hot group's rows with the id that stays, however many repeat it, the first in a
    written table is kept.

    Null text is the empty text. keep: "min" or "max", which id of a group stays;
    ids that are null come last. Rows that repeat both id and text count in
    group_size, and just one of them is kept. Other columns may have any names. An
    empty table gives an empty result.
    Returns id_col, keep_id, group_size, kept, text_sha256 and, with carry, the
    input row as the struct _row.
    """
    spark = docs.sparkSession
    parts = max(1, min(MOST_HOT, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] if carry else []
    base = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_raw"), F.struct(F.lit(0).alias("_"), *rest).alias("_rest")
    ).withColumn("_text", normalise(text_or_empty("_raw")))
    if not carry:
        base = base.drop("_raw", "_rest")
    base = base.withColumn("_key", F.xxhash64("_text"))

    total = docs.count()
    counts = base.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max(F.octet_length("_text")).alias("_bytes"))
    hot, size = [], 0
    for r in counts.filter(F.col("_n") * parts > max(total, 64 * parts)).orderBy(F.desc("_n"), "_key").collect():
        size += r["_bytes"]
        if size <= HOT_BYTES:
            hot.append(r["_key"])

    def finished(df: DataFrame) -> DataFrame:
        row = []
        if carry:
            source = {id_col: F.col("_id"), text_col: F.col("_raw")}
            row = [F.struct(*[source.get(c, F.col("_rest").getField(c)).alias(c) for c in docs.columns]).alias("_row")]
        return df.select(
            F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), *row
        )

    order = F.col("_id").asc_nulls_last() if keep == "min" else F.col("_id").desc_nulls_last()
    cold = base.filter(~F.col("_key").isin(hot)) if hot else base
    cold = cold.withColumn("_lead", F.substring("_text", 1, LEAD)).repartitionByRange("_lead", "_key")
    group = Window.partitionBy("_lead", "_key", "_text").orderBy(order)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    result = finished(
        cold.withColumns(
            {
                "keep_id": F.first("_id").over(whole),
                "group_size": F.count(F.lit(1)).over(whole),
                "kept": F.row_number().over(group) == 1,
            }
        )
    )
    if not hot:
        return result
    best = F.min("_id") if keep == "min" else F.max("_id")
    rows = base.filter(F.col("_key").isin(hot))
    groups = rows.groupBy("_key", "_text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rows = rows.join(F.broadcast(groups), ["_key", "_text"])
    first = F.col("_id").eqNullSafe(F.col("keep_id"))
    # one row of each group, or as many as repeat the id; their places in the written table are the same whenever it is read
    candidates = written(rows.filter(first)).withColumn("_at", F.monotonically_increasing_id())
    stays = candidates.groupBy("_key", "_text").agg(F.min("_at").alias("_stays"))
    candidates = candidates.join(F.broadcast(stays), ["_key", "_text"]).withColumn("kept", F.col("_at") == F.col("_stays"))
    return result.unionByName(finished(rows.filter(~first).withColumn("kept", F.lit(False)))).unionByName(finished(candidates))
