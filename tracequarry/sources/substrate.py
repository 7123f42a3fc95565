"""Trace tables over the driver's relational tables.

The event log stands for a capture: consecutive events are samples, users are spread
over four command streams, errors are timestamp boundaries. The columns are those that
a capture's own tables have, so that the operators are the same for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import call_kind
from ..operators.numbering import numbered

DAY_NS = 86_400_000_000_000
STREAM = ["device_index", "queue_index", "stream_index"]
THROUGHPUT = "sm__throughput.avg.pct_of_peak_sustained_elapsed"
HIT_RATE = "lts__hit_rate.ratio"
SPLIT = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "(-?[0-9]+)", 1).cast("bigint")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return table(spark, sf_dir, "events").select("event_id", ns.alias("start_ns"), "user_id", "event_type", "value", k.alias("k"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample. An event ends where the next one starts: ids are consecutive, so that is a join and no window over everything."""
    e = events(spark, sf_dir)
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("start_ns").alias("end_ns"))
    out = e.join(after, "event_id", "left").withColumnRenamed("event_id", "range_index")
    valid = F.col("end_ns").isNotNull() & (F.col("event_type") != "signup")
    return out.withColumns({"timestamp_valid": valid, "complete": F.col("event_type") != "error", "duration_ns": F.col("end_ns") - F.col("start_ns")})


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per sample and metric. Errors have no values."""
    s = samples(spark, sf_dir)
    shown = F.col("event_type") != "error"
    values = F.array(
        F.struct(F.lit(THROUGHPUT).alias("metric"), F.when(shown, F.least("value", F.lit(100.0))).alias("v")),
        F.struct(F.lit(HIT_RATE).alias("metric"), F.when(shown, F.col("k") / F.lit(100.0)).alias("v")),
    )
    keep = ["range_index", "start_ns", "end_ns", "timestamp_valid", "complete", "duration_ns"]
    return s.select(*keep, F.explode(values).alias("m")).select(*keep, "m.metric", F.col("m.v").alias("value"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with their place in their stream and in the capture."""
    e = events(spark, sf_dir)
    lane = F.col("user_id") % 4
    click = F.element_at(F.array(*map(F.lit, ("vkCmdDraw", "vkCmdDispatch", "vkCmdCopyBuffer", "vkCmdClearColorImage"))), (F.pmod("k", F.lit(4)) + 1).cast("int"))
    name = (
        F.when(F.col("event_type") == "signup", "vkCmdBeginDebugUtilsLabelEXT")
        .when(F.col("event_type") == "purchase", "vkCmdEndDebugUtilsLabelEXT")
        .when(F.col("event_type") == "view", "vkCmdBindPipeline")
        .when(F.col("event_type") == "error", "vkCmdPipelineBarrier")
        .otherwise(click)
    )
    e = e.select(
        F.lit(0).cast("bigint").alias("device_index"), F.floor(lane / 2).alias("queue_index"), (lane % 2).alias("stream_index"),
        name.alias("name"), "k", "start_ns", "event_id",
    )
    return global_index(e, "event_id").withColumn("kind", call_kind(F.col("name")))


def global_index(rows: DataFrame, order: str) -> DataFrame:
    """``call_index`` within the stream and ``global_index`` over streams in order, by offsets from per-stream counts."""
    counts = rows.groupBy(*STREAM).agg(F.count("*").alias("n"))
    before = Window.orderBy(*STREAM).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*STREAM, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.col("n").alias("stream_calls"))
    rows = numbered(rows, STREAM, order, "call_index")
    return rows.join(offsets, STREAM).withColumn("global_index", F.col("offset") + F.col("call_index")).drop("offset")


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per boundary and stage."""
    b = calls(spark, sf_dir).where("name = 'vkCmdPipelineBarrier'")
    b = b.withColumn("timestamp_index", F.row_number().over(Window.partitionBy(*STREAM).orderBy("call_index")) - 1)
    stages = F.array(
        F.struct(F.lit("BOTTOM_OF_PIPE").alias("stage"), F.col("start_ns").alias("ptimer")),
        F.struct(F.lit("TOP_OF_PIPE").alias("stage"), (F.col("start_ns") - 1000).alias("ptimer")),
    )
    return b.select(*STREAM, "timestamp_index", F.col("call_index").alias("next_call_index"), F.explode(stages).alias("s")).select(
        *STREAM, "timestamp_index", "next_call_index", "s.stage", "s.ptimer"
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each day."""
    day = F.floor(F.col("start_ns") / F.lit(DAY_NS))
    days = events(spark, sf_dir).select(day.alias("frame_index")).distinct()
    return days.select(
        F.concat(F.lit("frame:"), F.col("frame_index").cast("string")).alias("id"), "frame_index",
        (F.col("frame_index") * DAY_NS).alias("start_ns"), ((F.col("frame_index") + 1) * DAY_NS).alias("end_ns"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as intervals of their supplier's lane. Quantities are rounded to whole minutes, half to even, as DuckDB's CAST does."""
    start = F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000
    minutes = F.bround("l_quantity", 0).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("lane"), start.alias("start_ns"), (start + minutes * 60_000_000_000).alias("end_ns")
    )
