"""Scopes as a table: one row for each frame, marker range, action, timing bucket and profiler range, and what lies in them.

Columns are ``kind``, ``id``, ``label``, ``start_ns``, ``end_ns``, ``call_start``,
``call_stop`` (global call indexes), ``precision`` and ``warning``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_index_action
from .overlap import overlap_join
from .scopes import ScopeError
from .streams import STREAM, actions, debug_groups, scope_calls

COLUMNS = ("kind", "id", "label", "start_ns", "end_ns", "call_start", "call_stop", "precision", "warning")
# fixed values: texts of warnings
OPEN_GROUP = "Debug group is not closed in the capture."
NVTX_CLOCK = "Legacy NVTX clock is not assumed to match GPU PTIMER."
MOST_LISTED = 200


def stream_offsets(calls: DataFrame) -> DataFrame:
    """Each stream's first global call index."""
    return calls.groupBy(*STREAM).agg(F.min(F.col("global_index") - F.col("call_index")).alias("base"))


def global_buckets(buckets: DataFrame, calls: DataFrame) -> DataFrame:
    """Timing buckets with ``first_global`` and ``next_global``, numbered over the streams in order (``index``)."""
    own = buckets.groupBy(*STREAM).agg(F.count("*").alias("n"))
    before = Window.orderBy(*STREAM).rowsBetween(Window.unboundedPreceding, -1)  # one row per stream
    first = own.select(*STREAM, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_index"))
    b = buckets.join(stream_offsets(calls), STREAM).join(first, STREAM)
    return b.withColumns(
        {"first_global": F.col("base") + F.col("first_call"), "next_global": F.col("base") + F.col("next_call"), "index": F.col("first_index") + F.col("bucket_index")}
    ).drop("base", "first_index")


def _timed(kind: str, rows: DataFrame, buckets: DataFrame, width: int | None = None) -> DataFrame:
    """Scopes over calls (``id``, ``label``, ``call_start``, ``call_stop``, ``warning``) with the times of their buckets."""
    times = scope_calls(rows.select("id", "call_start", "call_stop"), buckets, width).select("id", "start_ns", "end_ns", "precision")
    return rows.join(times, "id").withColumn("kind", F.lit(kind)).select(*COLUMNS)


def debug_group_scopes(calls: DataFrame, buckets: DataFrame) -> DataFrame:
    g = debug_groups(calls).join(stream_offsets(calls), STREAM)
    rows = g.select(
        F.concat_ws(":", F.lit("debug"), *STREAM, "sequence").alias("id"), F.col("name").alias("label"),
        (F.col("base") + F.col("call_start")).alias("call_start"), (F.col("base") + F.col("call_stop")).alias("call_stop"),
        F.when(~F.col("closed"), OPEN_GROUP).alias("warning"),
    )
    return _timed("debug_group", rows, buckets)


def action_scopes(calls: DataFrame, buckets: DataFrame) -> DataFrame:
    at = F.col("global_index")
    rows = actions(calls).select(
        F.concat(F.lit("action:"), F.col("action_index").cast("string")).alias("id"),
        F.concat("name", F.lit(" (global call "), at.cast("string"), F.lit(")")).alias("label"),
        at.alias("call_start"), (at + 1).alias("call_stop"), F.lit(None).cast("string").alias("warning"),
    )
    return _timed("action", rows, buckets, 64)


def bucket_scopes(buckets: DataFrame) -> DataFrame:
    number = F.col("index").cast("string")
    rows = buckets.select(
        F.concat(F.lit("bucket:"), number).alias("id"), F.concat(F.lit("timing bucket "), number).alias("label"),
        F.col("first_global").alias("call_start"), F.col("next_global").alias("call_stop"), F.lit(None).cast("string").alias("warning"),
    )
    return _timed("timing_bucket", rows, buckets, 256)


def frame_scopes(frames: DataFrame) -> DataFrame:
    """Frames (``id``, ``frame_index``, ``start_ns``, ``end_ns`` and, if there is one, ``frame_kind``)."""
    kind = F.col("frame_kind") if "frame_kind" in frames.columns else F.lit("presented")
    return _by_time("frame", frames.withColumn("label", F.concat(kind, F.lit(" frame "), F.col("frame_index").cast("string"))), "frame_timestamps", None)


def nvtx_scopes(ranges: DataFrame) -> DataFrame:
    return _by_time("nvtx_range", ranges.withColumn("label", F.col("name")), "nvtx_clock_unvalidated", NVTX_CLOCK)


def _by_time(kind: str, rows: DataFrame, precision: str, warning: str | None) -> DataFrame:
    no_call = F.lit(None).cast("bigint")
    return rows.select(
        F.lit(kind).alias("kind"), "id", "label", "start_ns", "end_ns", no_call.alias("call_start"), no_call.alias("call_stop"),
        F.lit(precision).alias("precision"), F.lit(warning).cast("string").alias("warning"),
    )


def nvtx_ranges(push_pop: DataFrame, start_end: DataFrame) -> DataFrame:
    """Profiler ranges of both kinds (``position``, ``name``, ``start``, ``end``) under one id; a missing bound is 0."""
    one = lambda rows, kind: rows.select(
        F.concat(F.lit(f"nvtx:{kind}:"), F.col("position").cast("string")).alias("id"), "name",
        F.coalesce("start", F.lit(0)).cast("bigint").alias("start_ns"), F.coalesce("end", F.lit(0)).cast("bigint").alias("end_ns"),
    )
    return one(push_pop, "push_pop").union(one(start_end, "start_end"))


def shifted_nvtx(ranges: DataFrame, offset_ns: int) -> DataFrame:
    """Profiler ranges on the capture's clock; ``error`` says which can't be shifted. The offset is the caller's."""
    start, end = F.col("start_ns") + F.lit(offset_ns), F.col("end_ns") + F.lit(offset_ns)
    error = F.when((start < 0) | (end < 0), "clock offset underflows").when(end <= start, "clock offset produces an empty range")
    return ranges.select("id", "name", F.when(error.isNull(), start).alias("start_ns"), F.when(error.isNull(), end).alias("end_ns"), F.lit("nvtx_clock_offset").alias("precision"), error.alias("error"))


def sample_scope(samples: DataFrame, start: int, stop: int) -> DataFrame:
    """One row for the samples [``start``, ``stop``): the times of the valid ones, and how many of them there are."""
    if start > stop:
        raise ScopeError(f"invalid sample range [{start}, {stop})")
    s = samples.where((F.col("range_index") >= start) & (F.col("range_index") < stop))
    valid = F.col("timestamp_valid")
    got = s.agg(
        F.count("*").alias("selected"), F.count_if(valid).alias("valid"),
        F.min_by("start_ns", F.when(valid, F.col("range_index"))).alias("start_ns"), F.max_by("end_ns", F.when(valid, F.col("range_index"))).alias("end_ns"),
    )
    return got.select(
        F.lit(f"samples:{start}..{stop}").alias("id"), "start_ns", "end_ns", F.lit(start).cast("bigint").alias("sample_start"), F.lit(stop).cast("bigint").alias("sample_stop"),
        F.when(F.col("selected") < stop - start, "beyond the capture's samples").when(F.col("valid") < F.col("selected"), F.format_string("%d of %d selected samples have valid timestamps.", "valid", "selected")).alias("warning"),
    )


def scope_table(calls: DataFrame, buckets: DataFrame, frames: DataFrame | None = None, nvtx: DataFrame | None = None) -> DataFrame:
    """All families of scopes in one table; ``buckets`` are those of ``global_buckets``."""
    parts = [debug_group_scopes(calls, buckets), action_scopes(calls, buckets), bucket_scopes(buckets)]
    parts += [frame_scopes(frames)] if frames is not None else []
    parts += [nvtx_scopes(nvtx)] if nvtx is not None else []
    return reduce(DataFrame.unionByName, parts)


def scope_counts(calls: DataFrame, buckets: DataFrame, groups: DataFrame, frames: DataFrame | None = None, nvtx: DataFrame | None = None) -> DataFrame:
    """(``kind``, ``scopes``) of the five families; none is left out."""
    size = lambda df, kind: (df.agg(F.count("*").alias("scopes")) if df is not None else calls.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("scopes"))).select(F.lit(kind).alias("kind"), "scopes")
    families = ((groups, "debug_group"), (nvtx, "nvtx_range"), (frames, "frame"), (calls.where(is_index_action(F.col("kind"))), "action"), (buckets, "timing_bucket"))
    return reduce(DataFrame.union, [size(df, kind) for df, kind in families])


def calls_of(scopes: DataFrame, calls: DataFrame, buckets: DataFrame) -> DataFrame:
    """(``id`` and the columns of ``calls``) of each scope: those in its range, else those of the buckets that its time overlaps, each once.

    Ranges on an unvalidated clock hold none.
    """
    points = calls.withColumn("__next", F.col("global_index") + 1)
    ranged = scopes.where("call_start is not null and call_stop is not null").select("id", "call_start", "call_stop")
    by_range = overlap_join(ranged, points, ("call_start", "call_stop"), ("global_index", "__next"), width=1024).drop("call_start", "call_stop")
    timed = scopes.where("call_start is null and start_ns is not null and end_ns is not null and precision <> 'nvtx_clock_unvalidated'")
    timed = timed.select("id", F.col("start_ns").alias("__from"), F.col("end_ns").alias("__to"))
    spans = buckets.where("start_ns is not null and end_ns > start_ns").select("start_ns", "end_ns", "first_global", "next_global")
    touched = overlap_join(timed, spans, ("__from", "__to"), ("start_ns", "end_ns")).select("id", "first_global", "next_global").distinct()
    by_time = overlap_join(touched, points, ("first_global", "next_global"), ("global_index", "__next"), width=1024).drop("first_global", "next_global")
    return by_range.unionByName(by_time.dropDuplicates(["id", "global_index"])).drop("__next")


def call_evidence(of: DataFrame, top: int = 20) -> DataFrame:
    """Per scope (``calls_of``): calls, distinct names, the ``top`` names by count, and the count of each kind."""
    names = of.groupBy("id", "name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "name"))
    names = names.withColumn("rank", rank)
    listed = names.groupBy("id").agg(
        F.sum("n").alias("calls"), F.count("*").alias("distinct_names"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "name", "n")))).alias("h"),
    )
    kinds = of.groupBy("id", "kind").agg(F.count("*").alias("n")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("k"))
    text = lambda items, name: F.concat_ws(",", F.transform(items, lambda x: F.concat_ws(":", x[name], x["n"].cast("string"))))
    return listed.join(kinds, "id").select("id", "calls", "distinct_names", text(F.col("h"), "name").alias("histogram"), text(F.col("k"), "kind").alias("kinds"))


def states_of(of: DataFrame, states: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` action states (with ``global_index``) of each scope, in capture order."""
    inside = states.join(of.select("id", "global_index"), "global_index")
    order = Window.partitionBy("id").orderBy("global_index")
    return inside.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < limit)


def child_groups(groups: DataFrame) -> DataFrame:
    """(``id``, ``children``): each marker range's direct children, in order."""
    keys = [F.col(k) for k in STREAM]
    name = lambda seq: F.concat_ws(":", F.lit("debug"), *keys, seq)
    return groups.where("parent is not null").groupBy(*STREAM, "parent").agg(F.array_sort(F.collect_list("sequence")).alias("c")).select(
        name(F.col("parent")).alias("id"), F.size("c").cast("bigint").alias("children"), F.array_min("c").alias("first_child")
    )


def region_report(scopes: DataFrame, evidence: DataFrame, statistics: DataFrame) -> DataFrame:
    """Scopes with their time, their calls, and the least and greatest share of their time that metrics cover."""
    cover = statistics.groupBy("id").agg(F.min("coverage_pct").alias("least_metric_pct"), F.max("coverage_pct").alias("most_metric_pct"))
    out = scopes.select("id", "label", "start_ns", "end_ns", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"), "precision")
    return out.join(evidence.select("id", "calls", "distinct_names", "kinds"), "id", "left").join(cover, "id", "left")
