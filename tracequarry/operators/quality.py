"""Data-quality coverage and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent, saturating, status_rank, threshold_message, threshold_status

# fixed values: the info table and the name of each column's entry, and the table of settings
ENVIRONMENT = {
    "computer": ("System", "Computer Name"),
    "operating_system": ("System", "Operating System"),
    "gpu": ("GPU", "Device Name"),
    "chip": ("GPU", "Chip Name"),
    "driver": ("GPU", "Driver Version"),
    "product_version": ("Session", "Product Version"),
    "api": ("Session", "API"),
    "process": ("Session", "Process File Name"),
    "command_line": ("Session", "Command Line"),
}
SETTINGS = "Session Settings"


def counter_coverage(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Populated, complete and timestamped shares, durations, and the largest gap between valid samples (null if 0).

    The median is the upper one: in ascending order the value at half the count.
    """
    keys = by or []
    valid = samples.where("timestamp_valid")
    # the end of the valid sample before: valid samples are sparse in their order, so a window by block and the last end of earlier blocks
    block = F.floor(F.col("range_index") / 65536)
    inside = F.lag("end_ns").over(Window.partitionBy(*keys, "block").orderBy("range_index"))
    dealt = valid.withColumn("block", block)
    lasts = dealt.groupBy(*keys, "block").agg(F.max_by("end_ns", "range_index").alias("last_end"))
    lasts = lasts.select(*keys, "block", F.lag("last_end").over(Window.partitionBy(*keys).orderBy("block")).alias("carried"))
    steps = dealt.withColumn("inside", inside).join(lasts, [*keys, "block"])
    gap = saturating(F.col("start_ns"), F.coalesce("inside", "carried"))
    widest = steps.groupBy(*keys).agg(F.max(gap).alias("gap"))
    durations = samples.where("duration_ns is not null")
    n = durations.groupBy(*keys).agg(F.count("*").alias("n"))
    counts = durations.groupBy(*keys, "duration_ns").agg(F.count("*").alias("c"))
    running = F.sum("c").over(Window.partitionBy(*keys).orderBy("duration_ns").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", running)
    counts = counts.join(n, keys) if keys else counts.crossJoin(F.broadcast(n))
    median = counts.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*keys).agg(F.min("duration_ns").alias("median_sample_duration_ns"))
    sums = samples.groupBy(*keys).agg(
        F.count("*").alias("populated_ranges"), F.count_if("complete").alias("completed_ranges"), F.count_if("timestamp_valid").alias("timestamped_ranges"),
        F.sum("duration_ns").alias("sample_duration_ns"),
    )
    out = sums
    for other in (median, widest):
        out = out.join(other, keys, "left") if keys else out.crossJoin(F.broadcast(other))
    return out.select(
        *keys, "populated_ranges", "completed_ranges", "timestamped_ranges", "sample_duration_ns", "median_sample_duration_ns",
        F.when(F.col("gap") > 0, F.col("gap")).alias("max_sample_gap_ns"),
        percent(F.col("completed_ranges"), F.col("populated_ranges")).alias("complete_pct"), percent(F.col("timestamped_ranges"), F.col("populated_ranges")).alias("timestamped_pct"),
    )


def quality_checks(
    coverage: DataFrame | None, timing: DataFrame, buckets: DataFrame, frames: DataFrame, samples: DataFrame | None = None, environment: DataFrame | None = None
) -> DataFrame:
    """(``code``, ``status``, ``rank``, ``message``): one row per check, from one-row summaries.

    Without ``coverage`` there are no counters, and only ``counter_image`` says so. The
    window of the timing buckets is compared with that of ``samples`` where both have
    one, and ``environment`` (of ``capture_environment``) gives the checks of the
    machine and the session, of which only those that found something have a row.
    """
    shared = buckets.agg(F.count("*").alias("n"), F.count_if(F.col("call_count") > 1).alias("shared"))
    status = lambda bad: F.when(bad, "warn").otherwise("pass")
    row = lambda df, code, state, text: df.select(F.lit(code).alias("code"), (F.lit(state) if isinstance(state, str) else state).alias("status"), (F.lit(text) if isinstance(text, str) else text).alias("message"))
    share = lambda df, code, of, text: row(df, code, threshold_status(F.col(of)), threshold_message(text, F.col(of)))
    rows = []
    if coverage is None:
        rows.append(row(timing, "counter_image", "warn", "The capture holds no counter samples."))
    else:
        gap, median = F.coalesce("max_sample_gap_ns", F.lit(0)), F.col("median_sample_duration_ns")
        wide = (gap > F.lit(4) * median) & (median > 0)
        said = F.when(wide, F.concat(F.lit("Samples are up to "), gap.cast("string"), F.lit(" ns apart, more than four median samples."))).otherwise("Samples follow each other without wide gaps.")
        rows += [
            row(coverage, "counter_image", "pass", "The capture holds counter samples."),
            share(coverage, "counter_completeness", "complete_pct", "Completed periodic samples"),
            share(coverage, "counter_timestamps", "timestamped_pct", "Timestamped periodic samples"),
            row(coverage.where("median_sample_duration_ns is not null"), "counter_window_gaps", status(wide), said),
        ]
    if coverage is not None and samples is not None:
        valid = samples.where("timestamp_valid").agg(F.min_by("start_ns", "range_index").alias("from_ns"), F.max_by("end_ns", "range_index").alias("to_ns"))
        timed = buckets.where("start_ns is not null and end_ns is not null").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
        both = timed.crossJoin(F.broadcast(valid)).where("start_ns is not null and from_ns is not null")
        outside = (F.col("start_ns") < F.col("from_ns")) | (F.col("end_ns") > F.col("to_ns"))
        rows.append(row(both, "counter_timing_window", status(outside), F.when(outside, "Timing buckets begin before the samples or end after them.").otherwise("The samples cover all timing buckets.")))
    most = F.col("shared") * 2 > F.col("n")
    counted = F.concat(F.col("shared").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" timing buckets hold several calls."))
    rows += [
        share(timing, "call_timestamp_coverage", "coverage_pct", "Calls covered by timestamp buckets"),
        row(shared.where("n = 0"), "timing_buckets", "fail", "There are no timing buckets."),
        row(shared.where("n > 0"), "action_attribution", status(most), counted),
        row(frames.agg(F.count("*").alias("n")).where("n = 0"), "frame_markers", "warn", "There are no frames."),
    ]
    if environment is not None:
        rows += session_checks(environment)
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.select("code", "status", status_rank(F.col("status")).alias("rank"), "message")


def session_checks(environment: DataFrame) -> list[DataFrame]:
    """(``code``, ``status``, ``message``) of what the machine and the session's settings tell against a comparison."""
    setting = lambda name: F.try_element_at("settings", F.lit(name))
    clocks, vsync, every = setting("GPU Clocks"), setting("V-Sync Mode"), setting("Time Every Action")
    locked = F.lower(clocks).contains("locked")
    found = [
        ("environment_identity", F.col("gpu").isNull() | F.col("driver").isNull(), F.lit("The device or its driver isn't named.")),
        ("gpu_clocks", ~locked | F.lower(clocks).contains("boost"), F.concat(F.when(locked, "Clocks are locked to boost: ").otherwise("Clocks aren't locked: "), clocks)),
        ("vsync", ~F.lower(vsync).contains("off"), F.concat(F.lit("Frames wait for the display: "), vsync)),
        ("time_every_action", F.lower(every) == "no", F.lit("Not every action was timed.")),
    ]
    return [environment.where(bad).select(F.lit(code).alias("code"), F.lit("warn").alias("status"), text.alias("message")) for code, bad, text in found]


def overall_status(checks: DataFrame) -> DataFrame:
    """One row: the worst ``status`` of the checks, ``unknown`` if there is none."""
    return checks.agg(F.coalesce(F.max_by("status", "rank"), F.lit("unknown")).alias("status"))


def environment(entries: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: for each column its (table, name) entry's value; of several the last by ``ord``."""
    picks = [F.max_by("value", F.when((F.col("table") == t) & (F.col("name") == n), F.col("ord"))).alias(c) for c, (t, n) in names.items()]
    return entries.agg(*picks)


def capture_environment(entries: DataFrame) -> DataFrame:
    """One row: machine, session and a map ``settings``, from entries (``table``, ``name``, ``value``, ``ord``) of the info tables.

    Names and values lose white space at both ends; an entry without a value counts as
    empty, a column without an entry is null, and of several the last by ``ord`` counts.
    """
    text = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "").alias(c)
    said = entries.select(F.coalesce("table", F.lit("")).alias("table"), text("name"), text("value"), "ord")
    last = said.where(F.col("table") == SETTINGS).groupBy("name").agg(F.max_by("value", "ord").alias("value"))
    settings = last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("settings"))
    return environment(said, ENVIRONMENT).crossJoin(F.broadcast(settings))
