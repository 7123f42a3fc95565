"""Merging of intervals, timelines and pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import saturating


def merge_intervals(rows: DataFrame, by: list[str], start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """(``by``, ``start``, ``end``) of the unions of overlapping or touching intervals; empty ones are dropped."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.where(F.col(end) > F.col(start)).select(*by, start, end).withColumn("__new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__island", island).groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def merge_all(rows: DataFrame, start: str = "start_ns", end: str = "end_ns", slices: int = 4096) -> DataFrame:
    """Unions over all rows. They are merged within slices of the time first; what goes through one task is those unions, at most two of which meet at a slice's edge."""
    span = rows.agg(F.min(start), F.max(end)).first()
    if span[0] is None:
        return rows.select(start, end).limit(0)
    width = max(1, (span[1] - span[0]) // slices)
    part = rows.withColumn("__slice", F.floor((F.col(start) - F.lit(span[0])) / width))
    return merge_intervals(merge_intervals(part, ["__slice"], start, end), [], start, end)


def gaps(merged: DataFrame, by: list[str], min_gap: int = 0, start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """(``by``, ``gap_start``, ``gap_end``, ``gap_ns``) between consecutive unions, of ``min_gap`` at least."""
    after = F.lead(start).over(Window.partitionBy(*by).orderBy(start))
    out = merged.select(*by, F.col(end).alias("gap_start"), after.alias("gap_end")).where("gap_end is not null")
    return out.withColumn("gap_ns", F.col("gap_end") - F.col("gap_start")).where(F.col("gap_ns") >= min_gap)


def lane_timeline(rows: DataFrame, by: list[str], min_gap: int) -> DataFrame:
    """Per lane: first start, last end, busy and idle time, unions, and gaps of ``min_gap`` at least. Idle time holds shorter gaps too."""
    merged = merge_intervals(rows, by)
    busy = merged.groupBy(*by).agg(
        F.min("start_ns").alias("first_ns"), F.max("end_ns").alias("last_ns"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("busy_ns"), F.count("*").alias("unions")
    )
    long = gaps(merged, by, min_gap).groupBy(*by).agg(F.count("*").alias("gaps"), F.max("gap_ns").alias("longest_gap_ns"))
    out = busy.join(long, by, "left")
    return out.select(*by, "first_ns", "last_ns", "busy_ns", (F.col("last_ns") - F.col("first_ns") - F.col("busy_ns")).alias("gap_ns"), "unions", F.coalesce("gaps", F.lit(0)).alias("gaps"), "longest_gap_ns")


def top_gaps(rows: DataFrame, by: list[str], min_gap: int, top: int) -> DataFrame:
    found = gaps(merge_intervals(rows, by), by, min_gap)
    order = Window.partitionBy(*by).orderBy(F.col("gap_ns").desc(), "gap_start")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def global_timeline(rows: DataFrame, by: list[str], min_gap: int) -> DataFrame:
    """One row: union and summed busy time over lanes, their overlap and ratio, and the gaps of the union; of equally long gaps the last."""
    lanes = merge_intervals(rows, by)
    union = merge_all(lanes)
    whole = union.agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("union_busy_ns"))
    summed = lanes.agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("summed_busy_ns"))
    long = gaps(union, [], min_gap).agg(F.count("*").alias("gaps"), F.max("gap_ns").alias("longest_gap_ns"), F.max_by("gap_start", F.struct("gap_ns", "gap_start")).alias("longest_gap_start_ns"))
    out = whole.crossJoin(summed).crossJoin(long)
    return out.withColumns({"overlap_ns": F.col("summed_busy_ns") - F.col("union_busy_ns"), "parallelism": F.col("summed_busy_ns") / F.col("union_busy_ns")})


def frame_pacing(frames: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Frames with the gap since the one before, by (start, end, id)."""
    before = F.lag("end_ns").over(Window.partitionBy(*(by or [])).orderBy("start_ns", "end_ns", "id"))
    return frames.withColumn("duration_ns", saturating(F.col("end_ns"), F.col("start_ns"))).withColumn("gap_ns", F.when(before.isNotNull(), saturating(F.col("start_ns"), before)))


def frame_summary(frames: DataFrame) -> DataFrame:
    """One row: count, span, rates, and exact interpolated percentiles of durations and gaps."""
    p = frame_pacing(frames)
    span = F.max("end_ns") - F.min("start_ns")
    at = lambda c, q: F.round(F.percentile(c, F.lit(q))).cast("bigint")
    return p.agg(
        F.count("*").alias("frames"), span.alias("span_ns"), at("duration_ns", 0.5).alias("duration_p50"), at("duration_ns", 0.95).alias("duration_p95"),
        F.max("duration_ns").alias("duration_max"), at("gap_ns", 0.5).alias("gap_p50"), at("gap_ns", 0.95).alias("gap_p95"), F.max("gap_ns").alias("gap_max"),
        F.when(span > 0, F.count("*") * F.lit(1e9) / span).alias("fps"),
    )
