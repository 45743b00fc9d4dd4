"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_or_empty, word_count, written

#: Equal slices of the key's range for each source; only the slice with the last taken document is sorted.
SLICES = 4096


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most_epochs: int = 2
    seed: str = "mix-0"


def key_of(doc_id: Column, quality: Column, seed: str) -> Column:
    """-ln(u) / quality with u in (0, 1] from a digest of the id: smaller keys are drawn first."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1.0) / F.lit(float(2**52))
    return -F.ln(u) / quality


def quality_of(text: Column, size: Column) -> Column:
    """1 for plain prose, down to 0.25 for a text with a symbol for every word."""
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>!]")).cast("double")
    return 1.0 - 0.75 * F.least(F.lit(1.0), symbols / F.greatest(size, F.lit(1)).cast("double"))


def sized(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size and key of each row, without its text."""
    text = text_or_empty(text_col)
    df = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text).alias("_size"), text.alias("_text"))
    return df.select("_id", "_source", "_size", key_of(F.col("_id"), quality_of(F.col("_text"), F.col("_size")), mix.seed).alias("_key"))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: source_size, target, epochs and the words left for the fraction.

    The level at which all uncapped sources get weight x level is where, in the order
    of cap / weight, the remaining words first fit under the next cap.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    n = len(mix.weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), (F.row_number().over(order) - 1) % n + 1)
    df = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size")).withColumn("_weight", weight)
    df = df.withColumn("_cap", mix.most_epochs * F.col("source_size")).withColumn("_full_at", F.col("_cap") / F.col("_weight"))
    rising = Window.orderBy("_full_at", F.col("_source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * mix.share - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(rest)
    df = df.withColumn("_level", level).withColumn("_place", F.row_number().over(rising))
    found = F.min_by("_level", F.when(F.col("_level") <= F.col("_full_at"), F.col("_place"))).over(everything)
    df = df.withColumn("target", F.coalesce(F.least(F.col("_cap").cast("double"), found * F.col("_weight")), F.col("_cap").cast("double")))
    epochs = F.coalesce(F.floor(F.try_divide(F.floor(F.col("target") + 0.5), F.col("source_size"))), F.lit(0))
    return df.select("_source", "source_size", "target", epochs.alias("_epochs")).withColumn(
        "_rest", (F.floor(F.col("target") + 0.5) - F.col("_epochs") * F.col("source_size")).cast("long")
    )


def sampled(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The plan for each source: targets() and where its fraction ends.

    Keys are cut into SLICES slices. Sums of the slices, combined within map tasks, show
    in which one the fraction's last document lies; only that slice is sorted and summed,
    so no task ever holds a source. _cut_key and _cut_id name the last document,
    _cut_part how many of its words still fit, _cut_size its words.
    """
    plan = written(targets(sizes, mix))
    slice_ = F.least(F.floor((1.0 - F.exp(-F.col("_key"))) * SLICES), F.lit(SLICES - 1))
    sizes = sizes.withColumn("_slice", slice_)
    sums = sizes.groupBy("_source", "_slice").agg(F.sum("_size").alias("_sum"))
    running = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_upto", F.sum("_sum").over(running))
    same = F.col("s._source").eqNullSafe(F.col("p._source"))
    last = sums.alias("s").join(plan.alias("p"), same).filter((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_sum") < F.col("_rest")))
    last = last.select("s._source", "s._slice", (F.col("_upto") - F.col("_sum")).alias("_before"), "_rest")
    both = F.col("d._source").eqNullSafe(F.col("l._source")) & (F.col("d._slice") == F.col("l._slice"))
    inside = sizes.alias("d").join(last.alias("l"), both).select("d._source", "d._key", "d._id", "d._size", "l._before", "l._rest")
    inside = inside.groupBy("_source", "_key", "_id", "_before", "_rest").agg(F.sum("_size").alias("_size"))
    w = Window.partitionBy("_source").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_end", F.col("_before") + F.sum("_size").over(w)).filter(F.col("_end") >= F.col("_rest"))
    cut = inside.groupBy("_source").agg(F.min_by(F.struct("_key", "_id", "_size", "_end", "_rest"), F.struct("_key", "_id")).alias("_c"))
    cut = cut.select("_source", F.col("_c._key").alias("_cut_key"), F.col("_c._id").alias("_cut_id"), F.col("_c._size").alias("_cut_size"), (F.col("_c._rest") - F.col("_c._end") + F.col("_c._size")).alias("_cut_part"))
    same = F.col("p._source").eqNullSafe(F.col("c._source"))
    return written(plan.alias("p").join(cut.alias("c"), same, "left").select("p.*", "_cut_key", "_cut_id", "_cut_size", "_cut_part"))


def takes(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """sizes with its source's plan, and _fraction: words taken besides the complete epochs."""
    df = sizes.alias("d").join(plan.alias("p"), F.col("d._source").eqNullSafe(F.col("p._source")))
    before = (F.col("_key") < F.col("_cut_key")) | ((F.col("_key") == F.col("_cut_key")) & F.coalesce(F.col("_id") < F.col("_cut_id"), F.col("_id").isNull() & F.col("_cut_id").isNotNull()))
    at = (F.col("_key") == F.col("_cut_key")) & F.col("_id").eqNullSafe(F.col("_cut_id"))
    part = F.coalesce(F.expr("_cut_part * _size div nullif(_cut_size, 0)"), F.lit(0))
    fraction = F.when(before, F.col("_size")).when(at, part).otherwise(0).cast("long")
    return df.withColumn("_fraction", F.coalesce(fraction, F.lit(0).cast("long")))


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes.

    Sources in the order of their code points, null last, have the weights in turn and
    share mix.share times all words; a target stops at mix.most_epochs times its source,
    and what is over goes to the others by weight. A source's complete epochs come
    first; then documents in the order of their exponential keys, scaled by a quality
    weight, until the target is met. The last one gives only the words that still fit.

    Null text has no words; a null source is a source of its own; rows that repeat an
    id share its key and, where they meet the end of the fraction, its words in
    proportion. An empty table gives an empty result; a source without words takes none.
    Returns id_col, size, source_size, target, taken.
    """
    sizes = written(sized(docs, mix, id_col, text_col, source_col))
    df = takes(sizes, sampled(sizes, mix))
    return df.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_epochs") * F.col("_size") + F.col("_fraction")).cast("long").alias("taken")
    )


def mixed_rows(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs, once for each complete epoch, and once more whole if the fraction takes any of their words."""
    plan = sampled(written(sized(docs, mix, id_col, text_col, source_col)), mix)
    text = text_or_empty(text_col)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text).alias("_size"), text.alias("_text"))
    row = row.select("_row", "_id", "_source", "_size", key_of(F.col("_id"), quality_of(F.col("_text"), F.col("_size")), mix.seed).alias("_key"))
    taken = takes(row, plan)
    copies = F.col("_epochs") + F.when(F.col("_fraction") > 0, 1).otherwise(0)
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("_row.*")
