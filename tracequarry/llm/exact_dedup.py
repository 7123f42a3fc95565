"""Exact deduplication with a heavy-hitter split.

A Misra-Gries style frequent-items sketch finds the digests that hold more than a set
share of the rows. Their exact winners, counted over all rows, are at most
``counters`` rows and are broadcast, so that copies of very common texts are settled
on the map side. All other digests are shuffled as usual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lowered, materialize

COUNTERS = 1024


def digest(text) -> F.Column:
    """SHA-256 of the text with A-Z lower-cased, null as empty."""
    return F.unhex(F.sha2(F.encode(lowered(text), "UTF-8"), 256))


def heavy_winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(``digest``, ``n``, ``best``) of digests with more than 1 in ``counters`` of all rows.

    ``digests`` holds ``digest`` and ``best``, a struct whose greatest value wins.
    """
    sketch = digests.agg(
        F.expr(f"approx_top_k(xxhash64(digest), {counters}, {4 * counters})").alias("top"), F.count("*").alias("rows")
    )
    likely = sketch.select(F.explode("top.item").alias("h"), "rows")
    return (
        digests.join(F.broadcast(likely), F.xxhash64("digest") == F.col("h"))
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("best").alias("best"), F.first("rows").alias("rows"))
        .where(f"n > 1 and n * {counters} > rows")
        .select("digest", "n", "best")
    )


def mark_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after A-Z are lower-cased; null counts as empty. Of
    equal texts the row with the largest ``key`` stays (null keys are the smallest); of
    rows that also share the key exactly one stays. An empty table gives no rows. Other
    columns of ``docs`` aren't looked at.
    """
    rows = materialize(
        docs.select(
            F.struct(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row")).alias("best"),
            digest(F.col(text)).alias("digest"),
        )
    )
    winners = materialize(heavy_winners(rows, counters))  # at most `counters` rows
    heavy = rows.join(F.broadcast(winners.withColumnRenamed("best", "keep")), "digest").select("best", "digest", "keep", "n")
    same = Window.partitionBy("digest")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "best", "digest", F.max("best").over(same).alias("keep"), F.count("*").over(same).alias("n")
    )
    return heavy.unionByName(light).select(
        F.col("best.id").alias(key),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("best") == F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns.

    Ties between rows of equal text and key fall to the smallest hash of all columns.
    """
    d, k, h = "__digest", "__keep", "__hash"
    rows = docs.withColumn(d, digest(F.col(text)))
    small = materialize(rows.select(F.col(d).alias("digest"), F.struct(F.col(key).alias("id")).alias("best")))
    winners = heavy_winners(small, counters).select(F.col("digest").alias(d), F.col("best").alias(k))
    left = rows.join(F.broadcast(winners), d, "left").where(F.col(k).isNull() | F.col(key).eqNullSafe(F.col(f"{k}.id")))
    order = Window.partitionBy(d).orderBy(F.col(key).desc_nulls_last(), h)
    return (
        left.withColumn(h, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not _unhashable(docs, c)]))
        .withColumn(k, F.row_number().over(order))
        .where(F.col(k) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def _unhashable(docs: DataFrame, column: str) -> bool:
    kind = docs.schema[column].dataType.simpleString()
    return "map<" in kind or "variant" in kind
