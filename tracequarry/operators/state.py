"""State carried forward along a command stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_barrier, is_binding, is_pipeline_bind, is_state_action

STREAM = ["device_index", "queue_index", "stream_index"]


def action_states(calls: DataFrame, by: list[str] | None = None, barriers: int = 8) -> DataFrame:
    """One row per draw, dispatch, copy, clear or present: the pipeline bound last, how many bindings and barriers came since the action before, and the last ``barriers`` of these.

    ``handle`` is what a binding call binds.
    """
    keys = [*(by or []), *STREAM]
    order = Window.partitionBy(*keys).orderBy("call_index")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    action = is_state_action(F.col("kind"))
    c = calls.withColumns({
        "pipeline": F.last(F.when(is_pipeline_bind(F.col("name")), F.col("handle")), True).over(upto),
        "segment": F.coalesce(F.sum(action.cast("bigint")).over(before), F.lit(0)),
        "binding": is_binding(F.col("name")), "barrier": is_barrier(F.col("name")), "action": action,
    })
    segment = c.groupBy(*keys, "segment").agg(
        F.max(F.when(F.col("action"), F.struct("call_index", "name", "kind", "pipeline"))).alias("a"),
        F.count_if("binding").alias("bindings"), F.count_if("barrier").alias("barrier_count"),
        F.array_sort(F.collect_list(F.when(F.col("barrier"), F.col("call_index")))).alias("all_barriers"),
    )
    recent = F.slice("all_barriers", F.greatest(F.lit(1), F.size("all_barriers") - (barriers - 1)), F.lit(barriers))
    return segment.where("a is not null").select(*keys, F.col("segment").alias("action_index"), "a.call_index", "a.name", "a.kind", "a.pipeline", "bindings", "barrier_count", F.to_json(recent).alias("recent_barriers"))
