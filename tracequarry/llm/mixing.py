"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, scaled by its quality weight. A source's
target is met by whole epochs first; the rest is the prefix, in key order, of the
source's documents, cut within the last of them so that the target is met exactly.

A large source isn't sorted in one task: keys are cut into slices, slices are summed,
and a running total over slice sums gives each slice its offset. Slices are even for the
source's smallest weight; others are at most as much larger as their weight is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SLICE_ROWS = 1_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """A weight from 0.25 to 1: 1 for words of ordinary length, less the farther off."""
    mean = F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.25), F.lit(1.0) - F.abs(mean - F.lit(6.0)) / F.lit(10.0)))


def uniform(key: Column, text: Column, seed: int) -> Column:
    """Above 0 and below 1, from the key and the text: the same in every run."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(``source``, ``source_size``, ``docs``) with each source's ``target`` and its ``rank``.

    Sources by code point, null last, get the weights in turn and share ``share`` of
    all sizes; none is above ``most`` times its own size, and what is above is shared
    again by weight. Where the ceilings are met is found by one running sum over the
    sources in the order of ceiling by weight: the level that fits its source first is
    the highest that fits any. One row per source, so that the windows
    over all of them are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("level", F.col("ceiling") / F.col("weight"))
    rising = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("level", "rank").rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn(
        "reach",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("ceiling").over(rising), F.lit(0.0)))
        / F.sum("weight").over(rest),
    )
    ranked = ranked.withColumn("water", F.max(F.when(F.col("reach") <= F.col("level"), F.col("reach"))).over(everything))
    capped = F.col("water").isNull() | (F.col("level") <= F.col("water"))
    return ranked.select(
        "source", "source_size", "docs", "rank",
        F.when(capped, F.col("ceiling")).otherwise(F.col("water") * F.col("weight")).alias("target"),
    )


def _placed(docs: DataFrame, key: str, text: str, source: str, weights, share: float, most: float, seed: int, quality_weight: Column | None) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``size``, ``source``, ``order``, ``before``: words of the source before it in key order) of each row, with its source's figures; and those figures."""
    size, order, weight = _drawn(key, text, seed, quality_weight)
    rows = materialize(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), size.alias("size"), order.alias("order"), weight.alias("w")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), F.min("w").alias("least"))
    goal = targets(sizes, weights, share, most).join(sizes.select(F.col("source").alias("s"), "least"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    goal = materialize(goal.withColumn("whole", whole).withColumn("left", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))
    placed = rows.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.*", "source_size", "docs", "rank", "target", "least", "whole", "left")
    # 1 - exp(-order * least) rises with the key and lies between 0 and 1
    slices = F.floor(F.col("docs") / SLICE_ROWS) + 1
    placed = placed.withColumn("slice", F.floor((F.lit(1.0) - F.exp(-F.col("order") * F.col("least"))) * slices))
    sums = placed.groupBy("rank", "slice").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("rank", "slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("rank", "slice").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offsets, ["rank", "slice"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))), goal


def _drawn(key: str, text: str, seed: int, quality_weight: Column | None) -> tuple[Column, Column, Column]:
    """A row's size, key in the order of the draw, and weight."""
    size = word_count(F.col(text))
    weight = quality(F.col(text), size) if quality_weight is None else F.coalesce(quality_weight, F.lit(1.0))
    return size, -F.log(uniform(F.col(key), F.col(text), seed)) / weight, weight


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
    share: float = SHARE, most: float = MOST, seed: int = 20, quality_weight: Column | None = None,
) -> DataFrame:
    """One row per document: ``key``, ``size``, ``source``, ``source_size``, ``target``, ``taken``.

    ``size`` counts words, null text as none; whole texts are read, however long.
    ``taken`` is in words, repeats counted: whole epochs of the source, then documents in
    key order until the target is met; of the last one only the words that are still
    missing. ``quality_weight`` must lie above 0; null counts as 1. Documents without
    words take nothing. Null is a source like any other. Repeated rows have equal keys
    and follow each other. An empty table gives no rows; other columns aren't looked at.
    """
    placed, _ = _placed(docs, key, text, source, weights, share, most, seed, quality_weight)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    return placed.select(
        F.col("id").alias(key), "size", "source", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken")
    )


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
    share: float = SHARE, most: float = MOST, seed: int = 20, quality_weight: Column | None = None,
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document whole, once for each epoch that takes it.

    Of each source's last document at least half must be missing to the target for it to
    be taken. Documents without words, null texts among them, stay once. What is taken
    lies before one key in each source, so that texts aren't shuffled; rows with equal
    keys, ids and sizes are taken alike. An empty table gives no rows.
    """
    placed, goal = _placed(docs, key, text, source, weights, share, most, seed, quality_weight)
    mark = lambda order, key, size: F.struct(order.alias("order"), key.alias("id"), size.alias("size"))
    inside = placed.where((F.col("size") > 0) & (F.lit(2) * (F.col("left") - F.col("before")) >= F.col("size")))
    last = inside.groupBy("rank").agg(F.max(mark(F.col("order"), F.col("id"), F.col("size"))).alias("last"))
    goal = materialize(goal.join(last, "rank", "left").select(F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("last").alias("__last")))
    size, order, _ = _drawn(key, text, seed, quality_weight)
    chosen = docs.join(goal, F.col(source).eqNullSafe(F.col("__source"))).withColumn("__size", size)
    taken = F.col("__whole") + F.coalesce(mark(order, F.col(key), F.col("__size")) <= F.col("__last"), F.lit(False)).cast("int")
    copies = F.when(F.col("__size") > 0, taken).otherwise(1).cast("int")
    chosen = chosen.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return chosen.select(*[F.col(f"`{c}`") for c in docs.columns])
