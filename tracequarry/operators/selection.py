"""Filtered and paged reads of a capture's tables, and the choice of regions and metrics.

Patterns are regular expressions that match anywhere; those of metrics don't tell case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diagnostics import described
from .overlap import overlap_join
from .streams import STREAM

# fixed values: limits of the interface
MOST_ROWS = 100
MOST_SELECTED = 48
MOST_READ = 16 * 1024
COMPARED, FEW_COMPARED = 16, 8


def paged(rows: DataFrame, order: list, offset: int = 0, limit: int = 50, most: int = MOST_ROWS) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))


def matching(pattern: str | None, *columns: str) -> Column:
    """Whether any of the columns matches; all rows do without a pattern."""
    if pattern is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns])


def of_kind(kind: str | None) -> Column:
    return F.lit(True) if kind is None else F.col("kind") == kind


def calls_query(calls: DataFrame, kind: str | None = None, pattern: str | None = None) -> DataFrame:
    return calls.where(of_kind(kind) & matching(pattern, "name"))


def timings_of_one_call(buckets: DataFrame, calls: DataFrame, kind: str | None = None, pattern: str | None = None) -> DataFrame:
    """Buckets that hold a call which is of ``kind`` and matches as well."""
    return buckets if kind is None and pattern is None else _holding(buckets, calls_query(calls, kind, pattern))


def timings_of_any_calls(buckets: DataFrame, calls: DataFrame, kind: str | None = None, pattern: str | None = None) -> DataFrame:
    """Buckets that hold a call of ``kind``, and one that matches, which may be another."""
    out = buckets if kind is None else _holding(buckets, calls_query(calls, kind))
    return out if pattern is None else _holding(out, calls_query(calls, None, pattern))


def _holding(buckets: DataFrame, calls: DataFrame) -> DataFrame:
    points = calls.select(*STREAM, F.col("call_index").alias("__at"), (F.col("call_index") + 1).alias("__next"))
    hit = overlap_join(buckets.select(*STREAM, "bucket_index", "first_call", "next_call"), points, ("first_call", "next_call"), ("__at", "__next"), STREAM, 256)
    return buckets.join(hit.select(*STREAM, "bucket_index").distinct(), [*STREAM, "bucket_index"], "left_semi")


def scopes_query(scopes: DataFrame, kind: str, pattern: str | None = None) -> DataFrame:
    return scopes.where(of_kind(kind) & matching(pattern, "id", "label"))


def actions_query(states: DataFrame, kind: str | None = None, pattern: str | None = None) -> DataFrame:
    return states.where(of_kind(kind) & matching(pattern, "name"))


def artifacts_query(artifacts: DataFrame, pattern: str | None = None) -> DataFrame:
    return artifacts.where(matching(pattern, "path", "message_type"))


def read_artifact(artifacts: DataFrame, path: str, offset: int = 0, limit: int = 4096) -> DataFrame:
    """One row: the bytes [``offset``, ``offset`` + ``limit``) of ``content`` in hexadecimal, and where the page ends."""
    limit = max(1, min(MOST_READ, limit))
    size = F.length("content")
    start = F.least(F.lit(offset), size)
    stop = F.least(size, start + limit)
    return artifacts.where(F.col("path") == path).select(
        "path", F.lower(F.hex(F.substring("content", start + 1, stop - start))).alias("data"), start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"), size.cast("bigint").alias("total")
    )


def region_kind(counts: DataFrame) -> str:
    """The family that stands for regions: the first that has scopes."""
    have = {r["kind"] for r in counts.where("scopes > 0").collect()}  # five rows
    return next((k for k in ("debug_group", "nvtx_range", "frame", "timing_bucket") if k in have), "none")


def select_regions(scopes: DataFrame, kind: str, pattern: str | None = None, top: int = 8) -> DataFrame:
    """The longest scopes of ``kind``: 128 at least and 256 at most are candidates."""
    chosen = scopes_query(scopes, kind, pattern).withColumn("duration_ns", F.when(F.col("end_ns") >= F.col("start_ns"), F.col("end_ns") - F.col("start_ns")))
    return chosen.orderBy(F.col("duration_ns").desc_nulls_last(), "id").limit(max(128, min(256, top)))


def select_metrics(scan: DataFrame, found: DataFrame, exact: list[str] = (), patterns: list[str] = (), top: int = 8) -> DataFrame:
    """(``metric``, ``place``): asked-for names, those of findings, each category's leader, then pattern matches by mean; each once, ``MOST_SELECTED`` at most."""
    spark = scan.sparkSession
    s = described(scan).where("valid_samples > 0")
    pressure = F.coalesce("p95", "mean")
    lead = Window.partitionBy("category").orderBy(F.when(F.col("kind") == "throughput", 0).otherwise(1), F.when(F.col("kind") == "throughput", pressure).desc_nulls_last(), "metric")
    leaders = s.withColumn("r", F.row_number().over(lead)).where("r = 1")
    hit = reduce(lambda a, b: a | b, [F.col(c).rlike(f"(?i){p}") for p in patterns for c in ("base", "metric")], F.lit(False))
    matched = s.where(hit).orderBy(F.col("sample_mean").desc_nulls_last(), "metric").limit(max(0, top))
    parts = [
        spark.createDataFrame([(0, float(k), m) for k, m in enumerate(exact)], "step int, rank double, metric string"),
        found.select(F.lit(1).alias("step"), (-F.coalesce("mean", F.lit(0.0))).alias("rank"), "metric"),
        leaders.select(F.lit(2), F.lit(0.0), F.col("metric")),
        matched.select(F.lit(3), -F.coalesce("sample_mean", F.lit(-1e308)), F.col("metric")),
    ]
    first = reduce(DataFrame.union, parts).groupBy("metric").agg(F.min(F.struct("step", "rank", "metric")).alias("at"))
    few = first.orderBy("at").limit(MOST_SELECTED)
    return few.select("metric", (F.row_number().over(Window.orderBy("at")) - 1).alias("place"))  # 48 rows


def scan_by_kind(scan: DataFrame) -> DataFrame:
    """(``kind``, ``scanned``, ``available``)."""
    return described(scan).groupBy("kind").agg(F.count("*").alias("scanned"), F.count_if(F.col("valid_samples") > 0).alias("available"))


def compared_metrics(deltas: DataFrame, baseline: DataFrame) -> DataFrame:
    """(``metric``): those of ranked ``deltas`` that aren't counters; fewer than ``FEW_COMPARED`` are filled up from the baseline's throughputs and ratios by p95."""
    own = described(deltas.withColumns({"time_weighted_mean": F.lit(None), "sample_mean": F.lit(None)})).where("kind <> 'counter'")
    own = own.select("metric", F.lit(0).alias("step"), F.lit(0.0).alias("rank"))
    more = described(baseline).where("valid_samples > 0 and kind in ('throughput', 'ratio')").select("metric", F.lit(1).alias("step"), (-F.coalesce("p95", F.lit(-1e308))).alias("rank"))
    few = own.agg((F.count("*") < FEW_COMPARED).alias("few"))
    both = own.union(more.crossJoin(F.broadcast(few)).where("few").drop("few"))
    return both.groupBy("metric").agg(F.min(F.struct("step", "rank", "metric")).alias("at")).orderBy("at").limit(COMPARED).select("metric")
