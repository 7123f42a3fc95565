"""Joins of scopes with samples and calls by overlap.

An interval join would be planned as a nested loop. Both sides are cut into bins
instead and joined on the bin; a pair that shares several bins is taken in the one that
holds the later of the two starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins that [start, end) touches; none for an empty interval."""
    last = F.greatest(F.floor((end - 1) / width), F.floor(start / width))
    return F.when(end > start, F.sequence(F.floor(start / width), last))


def mean_length(df: DataFrame, start: str, end: str) -> int:
    got = df.where(F.col(end) > F.col(start)).agg(F.avg(F.col(end) - F.col(start))).first()[0]
    return max(1, int(got or 1))


def overlap_join(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: list[str] | None = None, width: int | None = None
) -> DataFrame:
    """Pairs of rows whose half-open intervals overlap, and that agree in ``on``.

    ``width`` of a bin is the longer side's mean length by default, so that a row has
    a few bins on either side.
    """
    (ls, le), (rs, re) = left_span, right_span
    width = width or max(mean_length(left, ls, le), mean_length(right, rs, re))
    l = left.withColumn("__bin", F.explode(bins(F.col(ls), F.col(le), width)))
    r = right.withColumn("__bin", F.explode(bins(F.col(rs), F.col(re), width)))
    both = l.join(r, [*(on or []), "__bin"])
    meet = (F.col(rs) < F.col(le)) & (F.col(re) > F.col(ls))
    return both.where(meet & (F.floor(F.greatest(ls, rs) / width) == F.col("__bin"))).drop("__bin")


def attach_samples(scopes: DataFrame, samples: DataFrame, on: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Scopes (``id``, ``start_ns``, ``end_ns``) with ``sample_start`` and ``sample_stop``: the contiguous slice from the first to the last valid sample that overlaps.

    Without such a sample the slice is empty and lies where the scope would start.
    """
    keys = [*(on or []), "id"]
    valid = samples.where("timestamp_valid").select(*(on or []), "range_index", F.col("start_ns").alias("s_start"), F.col("end_ns").alias("s_end"))
    hits = overlap_join(scopes.select(*keys, "start_ns", "end_ns"), valid, ("start_ns", "end_ns"), ("s_start", "s_end"), on, width)
    slices = hits.groupBy(*keys).agg(F.min("range_index").alias("first"), (F.max("range_index") + 1).alias("stop"))
    empty = F.lit(0).cast("bigint")
    return scopes.join(slices, keys, "left").select(
        *[scopes[c] for c in scopes.columns], F.coalesce("first", empty).alias("sample_start"), F.coalesce("stop", empty).alias("sample_stop"),
        F.when(F.col("first").isNull(), "no timestamped sample overlaps").alias("warning"),
    )


def slice_rows(slices: DataFrame, rows: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows with ``range_index`` in [``sample_start``, ``sample_stop``) of each slice, by blocks of the index."""
    cut = slices.withColumn("__block", F.explode(bins(F.col("sample_start"), F.col("sample_stop"), BLOCK)))
    dealt = rows.withColumn("__block", F.floor(F.col("range_index") / BLOCK))
    inside = (F.col("range_index") >= F.col("sample_start")) & (F.col("range_index") < F.col("sample_stop"))
    return cut.join(dealt, [*(on or []), "__block"]).where(inside).drop("__block")
