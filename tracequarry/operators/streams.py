"""Command streams: ranges, timing buckets, and what calls belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import call_kind, is_index_action, marker_direction
from .numbering import numbered
from .overlap import overlap_join

STREAM = ["device_index", "queue_index", "stream_index"]


def call_histogram(calls: DataFrame) -> DataFrame:
    return calls.groupBy("name").agg(F.count("*").alias("calls")).withColumn("kind", call_kind(F.col("name")))


def debug_groups(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ranges of opening and closing markers, matched like brackets in each stream.

    A close without an open is passed over; an open without a close ends with the
    stream. The depth of a stream is its running sum of opens and closes above the
    lowest point so far, so that no stack is kept.
    """
    keys = [*(by or []), *STREAM]
    order = Window.partitionBy(*keys).orderBy("call_index")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    m = calls.withColumn("d", marker_direction(F.col("name"))).where("d is not null")
    m = m.withColumn("s", F.sum("d").over(upto)).withColumn("low", F.least(F.lit(0), F.min("s").over(upto)))
    m = m.withColumn("depth", F.col("s") - F.col("low"))
    m = m.withColumn("before", F.coalesce(F.lag("depth").over(order), F.lit(0))).where("d = 1 or before > 0")
    m = m.withColumn("level", F.when(F.col("d") == 1, F.col("before")).otherwise(F.col("depth")))
    level = Window.partitionBy(*keys, "level").orderBy("call_index")
    m = m.withColumns({"close_index": F.lead("call_index").over(level), "sequence": F.row_number().over(Window.partitionBy(*keys, "d").orderBy("call_index")) - 1})
    opens = m.where("d = 1")
    # the parent is the last open one level up; level by level that is an as-of lookup
    tagged = opens.select(*keys, "call_index", F.col("level").alias("lv"), "sequence", F.lit(1).alias("own")).union(
        opens.select(*keys, "call_index", (F.col("level") + 1).alias("lv"), "sequence", F.lit(0).alias("own"))
    )
    asof = Window.partitionBy(*keys, "lv").orderBy("call_index", "own").rowsBetween(Window.unboundedPreceding, -1)
    parent = tagged.withColumn("parent", F.last(F.when(F.col("own") == 0, F.col("sequence")), True).over(asof)).where("own = 1")
    return opens.join(parent.select(*keys, "call_index", "parent"), [*keys, "call_index"]).select(
        *keys, "sequence", "name", F.col("level").alias("depth"), "parent", F.col("call_index").alias("call_start"),
        F.coalesce("close_index", "stream_calls").alias("call_stop"), F.col("close_index").isNotNull().alias("closed"),
    )


def timing_buckets(boundaries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Buckets between consecutive boundaries of a stream, with the stages that both have.

    Of a stage that a boundary holds twice the last value counts. A stage is kept if
    its start is above 0 and its end later. ``interval`` is that of the bottom stage,
    else of the first stage by name.
    """
    keys = [*(by or []), *STREAM]
    one = boundaries.groupBy(*keys, "timestamp_index", "next_call_index", "stage").agg(F.max("ptimer").alias("ptimer"))
    points = one.groupBy(*keys, "timestamp_index", "next_call_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ptimer")))).alias("at"))
    order = Window.partitionBy(*keys).orderBy("timestamp_index")
    pairs = points.select(*keys, "timestamp_index", "next_call_index", "at", F.lead("at").over(order).alias("then"), F.lead("next_call_index").over(order).alias("stop"))
    pairs = pairs.where("then is not null")
    usable = lambda s: (F.col("at")[s] > 0) & (F.col("then")[s] > F.col("at")[s])
    stages = F.filter(F.map_keys("at"), lambda s: F.coalesce(usable(s), F.lit(False)))
    pairs = pairs.withColumn("stages", F.transform(stages, lambda s: F.struct(s.alias("stage"), F.col("at")[s].alias("start_ns"), F.col("then")[s].alias("end_ns"))))
    bottom = F.filter("stages", lambda s: s["stage"] == "BOTTOM_OF_PIPE")
    chosen = F.coalesce(F.get(bottom, 0), F.get("stages", 0))
    return pairs.select(
        *keys, F.col("timestamp_index").alias("bucket_index"), F.col("next_call_index").alias("first_call"), F.col("stop").alias("next_call"),
        (F.col("stop") - F.col("next_call_index")).alias("call_count"), F.size("stages").alias("stage_count"),
        F.array_max(F.transform("stages", lambda s: s["end_ns"] - s["start_ns"])).alias("max_duration_ns"),
        chosen["start_ns"].alias("start_ns"), chosen["end_ns"].alias("end_ns"),
    )


def bucket_kinds(buckets: DataFrame, calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls of each kind in each bucket."""
    keys = [*(by or []), *STREAM]
    spans = buckets.select(*keys, "bucket_index", "first_call", "next_call")
    points = calls.select(*keys, "call_index", (F.col("call_index") + 1).alias("call_end"), "kind")
    hits = overlap_join(spans, points, ("first_call", "next_call"), ("call_index", "call_end"), keys)
    return hits.groupBy(*keys, "bucket_index", "kind").agg(F.count("*").alias("calls"))


def scope_calls(scopes: DataFrame, buckets: DataFrame, width: int | None = None) -> DataFrame:
    """Scopes over calls (``id``, ``call_start``, ``call_stop`` as global indexes) with the times of the buckets that they touch, and how exact those are.

    ``timestamp_bounded`` if the buckets fit the scope, ``bucket_shared`` if one
    reaches outside, ``partially_timestamped`` if some calls have no bucket and none is
    shared, ``multi_stream_envelope`` if they lie in several streams, ``unavailable``
    without any bucket. Later rules override earlier ones.
    """
    usable = buckets.where("start_ns is not null").select(*STREAM, "first_global", "next_global", F.col("start_ns").alias("b_start"), F.col("end_ns").alias("b_end"))
    hits = overlap_join(scopes, usable, ("call_start", "call_stop"), ("first_global", "next_global"), width=width)
    shared = (F.col("first_global") < F.col("call_start")) | (F.col("next_global") > F.col("call_stop"))
    found = hits.groupBy("id").agg(
        F.min("b_start").alias("start_ns"), F.max("b_end").alias("end_ns"), F.bool_or(shared).alias("shared"), F.count_distinct(F.struct(*STREAM)).alias("streams"),
        F.sum(F.least("call_stop", "next_global") - F.greatest("call_start", "first_global")).alias("covered"),
    )
    out = scopes.join(found, "id", "left")
    precision = (
        F.when(F.col("streams").isNull(), "unavailable")
        .when(F.col("streams") > 1, "multi_stream_envelope")
        .when(F.col("shared"), "bucket_shared")
        .when(F.col("covered") < F.col("call_stop") - F.col("call_start"), "partially_timestamped")
        .otherwise("timestamp_bounded")
    )
    return out.select("id", "call_start", "call_stop", "start_ns", "end_ns", F.coalesce("covered", F.lit(0)).alias("covered"), precision.alias("precision"))


def actions(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls that aren't markers, numbered in capture order by offsets from per-stream counts."""
    keys = [*(by or []), *STREAM]
    a = calls.where(is_index_action(F.col("kind")))
    counts = a.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*(by or [])).orderBy(*STREAM).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return numbered(a, keys, "call_index", "own").join(offsets, keys).withColumn("action_index", F.col("base") + F.col("own")).drop("own", "base")


def covered_calls(buckets: DataFrame, calls: DataFrame, usable_only: bool) -> DataFrame:
    """(``calls``, ``covered``, ``coverage_pct``): calls within buckets; those of a stream don't overlap, so that is a sum of lengths."""
    b = buckets.where("start_ns is not null") if usable_only else buckets
    n = calls.agg(F.count("*").alias("calls"))
    c = b.agg(F.coalesce(F.sum("call_count"), F.lit(0)).alias("covered"))
    both = n.crossJoin(c)
    return both.withColumn("coverage_pct", F.when(F.col("calls") == 0, F.lit(0.0)).otherwise(F.col("covered") * F.lit(100.0) / F.col("calls")))


def workload_summary(calls: DataFrame, top: int = 20) -> DataFrame:
    """Rows (``section``, ``name``, ``value``): totals, calls of each kind and device, and the ``top`` commonest names."""
    per_kind = calls.groupBy(F.lit("kind").alias("section"), F.col("kind").alias("name")).agg(F.count("*").alias("value"))
    per_device = calls.groupBy(F.lit("device").alias("section"), F.col("device_index").cast("string").alias("name")).agg(F.count("*").alias("value"))
    names = calls.groupBy(F.lit("name").alias("section"), "name").agg(F.count("*").alias("value")).orderBy(F.desc("value"), "name").limit(top)
    totals = calls.agg(F.count("*").alias("calls"), F.count_if(is_index_action(F.col("kind"))).alias("actions"))
    totals = totals.select(F.explode(F.create_map(F.lit("calls"), "calls", F.lit("actions"), "actions"))).select(F.lit("total").alias("section"), F.col("key").alias("name"), "value")
    return totals.union(per_kind).union(per_device).union(names.select("section", "name", "value"))
