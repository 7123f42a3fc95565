"""Composite reports, put together from the operators.

A report is a dict of DataFrames, one for each section; nothing runs before a section
is read. A section whose tables are missing is None, and ``unavailable`` says why: a
report is given with what there is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import metric_kind
from ..operators import compare, diagnostics, intervals, quality, ranking, scope_tables, selection, shaders, state, statistics, streams
from ..operators.overlap import overlap_join
from ..operators.scopes import ScopeError, parse_scope, time_scope


@dataclass(frozen=True)
class Capture:
    """The tables of a capture; what it doesn't have is None."""

    calls: DataFrame | None = None
    boundaries: DataFrame | None = None
    frames: DataFrame | None = None
    samples: DataFrame | None = None
    metric_samples: DataFrame | None = None
    info_entries: DataFrame | None = None
    nvtx: DataFrame | None = None
    shaders: DataFrame | None = None
    artifacts: DataFrame | None = None


@dataclass
class Report:
    sections: dict[str, DataFrame | None] = field(default_factory=dict)
    unavailable: list[str] = field(default_factory=list)

    def add(self, name: str, needs: tuple[object, ...], make) -> DataFrame | None:
        if any(x is None for x in needs):
            self.sections[name] = None
            self.unavailable.append(f"{name}: a table that it needs isn't in the capture")
        else:
            self.sections[name] = make()
        return self.sections[name]


def analyze(capture: Capture, top: int = 8, width: int | None = None) -> Report:
    """Metric scan, diagnostics, regions by score, timing, quality and workload of a capture; its frames are the regions."""
    c, out = capture, Report()
    scan = out.add("metric_scan", (c.metric_samples,), lambda: statistics.metric_scan(c.metric_samples))
    out.add("categories", (scan,), lambda: diagnostics.category_summary(scan))
    out.add("findings", (scan,), lambda: diagnostics.findings(scan))
    out.add("low_hit_rates", (scan,), lambda: diagnostics.low_hit_rates(scan))
    out.add("activity", (scan,), lambda: diagnostics.activity_ratio(scan))
    stats = out.add("region_metrics", (c.frames, c.samples, scan), lambda: statistics.overlap_statistics(c.frames, c.samples, c.metric_samples, width=width))
    out.add("regions", (stats,), lambda: ranking.rank_regions(c.frames, stats, scan, top))
    buckets = out.add("timing_buckets", (c.boundaries,), lambda: streams.timing_buckets(c.boundaries))
    timing = out.add("timing", (buckets, c.calls), lambda: streams.covered_calls(buckets, c.calls, False))
    coverage = out.add("counter_coverage", (c.samples,), lambda: quality.counter_coverage(c.samples))
    told = None if c.info_entries is None else quality.capture_environment(c.info_entries)
    out.add("quality", (timing, buckets, c.frames), lambda: quality.quality_checks(coverage, timing, buckets, c.frames, c.samples, told))
    out.add("frames", (c.frames,), lambda: intervals.frame_summary(c.frames))
    out.add("workload", (c.calls,), lambda: streams.workload_summary(c.calls))
    return out


def compare_captures(baseline: Capture, candidate: Capture, top: int = 8) -> Report:
    """Metric differences of two captures, ranked, and the scopes that both have."""
    a, b, out = baseline, candidate, Report()
    deltas = out.add(
        "metric_deltas", (a.metric_samples, b.metric_samples),
        lambda: compare.metric_deltas(statistics.metric_scan(a.metric_samples), statistics.metric_scan(b.metric_samples)),
    )
    out.add("ranked_deltas", (deltas,), lambda: compare.ranked_deltas(deltas, top))
    out.add("metrics", (deltas,), lambda: selection.compared_metrics(deltas.select("metric"), statistics.metric_scan(a.metric_samples)))
    spans = lambda f: scope_tables.frame_scopes(f).select("id", "label", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"))
    matched = out.add("frames", (a.frames, b.frames), lambda: compare.match_scopes(spans(a.frames), spans(b.frames), top))

    def scope_deltas() -> DataFrame:
        means = lambda c: statistics.overlap_statistics(c.frames, c.samples, c.metric_samples)
        return compare.scope_metric_deltas(matched.select("id_a", "id_b", "duration_pct"), means(a), means(b))

    scoped = out.add("scope_deltas", (matched, a.samples, b.samples, a.metric_samples, b.metric_samples), scope_deltas)
    out.add("ranked_scopes", (scoped,), lambda: compare.ranked_scopes(scoped, top))
    return out


#: Limits of the interface.
MOST_QUERIES, MOST_METRICS, MOST_PATTERNS, MOST_SCOPES = 16, 64, 16, 1024


class QueryError(ValueError):
    """A query that can't be answered as it is asked."""


def _index(capture: Capture) -> dict[str, DataFrame | None]:
    """Tables that several queries need; each is made when it is read."""
    c = capture
    if c.calls is None or c.boundaries is None:
        raise QueryError("the capture has no calls or no timestamp boundaries")
    buckets = scope_tables.global_buckets(streams.timing_buckets(c.boundaries), c.calls)
    return {"calls": c.calls, "buckets": buckets, "groups": streams.debug_groups(c.calls), "scopes": scope_tables.scope_table(c.calls, buckets, c.frames, c.nvtx)}


def _states(capture: Capture) -> DataFrame:
    handles = capture.calls if "handle" in capture.calls.columns else capture.calls.withColumn("handle", F.lit(None).cast("string"))
    return state.action_states(handles)


def _page(rows: DataFrame, query: dict, order: list) -> DataFrame:
    return selection.paged(rows, order, int(query.get("offset", 0)), int(query.get("limit", 50)))


def _calls(capture: Capture, q: dict) -> DataFrame:
    return _page(selection.calls_query(capture.calls, q.get("kind"), q.get("pattern")), q, ["global_index"])


def _timings(capture: Capture, q: dict) -> DataFrame:
    found = selection.timings_of_one_call(_index(capture)["buckets"], capture.calls, q.get("kind"), q.get("pattern"))
    return _page(found, q, [F.col("max_duration_ns").desc_nulls_last(), "index"])


def _scopes(capture: Capture, q: dict) -> DataFrame:
    if "kind" not in q:
        raise QueryError("kind is required")
    return _page(selection.scopes_query(_index(capture)["scopes"], q["kind"], q.get("pattern")), q, ["call_start", "start_ns", "id"])


def _inspect(capture: Capture, q: dict) -> DataFrame:
    return inspect_scope(capture, q["scope"])["calls"]


def _need(table: DataFrame | None, what: str) -> DataFrame:
    if table is None:
        raise QueryError(f"the capture has no {what}")
    return table


def _quality(capture: Capture, q: dict) -> DataFrame:
    c = capture
    buckets = streams.timing_buckets(_need(c.boundaries, "timestamp boundaries"))
    coverage = None if c.samples is None else quality.counter_coverage(c.samples)
    told = None if c.info_entries is None else quality.capture_environment(c.info_entries)
    timing = streams.covered_calls(buckets, _need(c.calls, "calls"), False)
    return quality.quality_checks(coverage, timing, buckets, _need(c.frames, "frames"), c.samples, told)


def _lanes(capture: Capture) -> DataFrame:
    return streams.timing_buckets(_need(capture.boundaries, "timestamp boundaries")).where("start_ns is not null")


def _most(q: dict, name: str, default: int) -> int:
    return max(1, min(selection.MOST_ROWS, q.get(name, default)))


def _discovery(capture: Capture, q: dict) -> DataFrame:
    """Metrics that were collected, by kind and by a pattern that doesn't tell case."""
    names = _need(capture.metric_samples, "metric samples").select("metric").distinct().withColumn("kind", metric_kind(F.col("metric")))
    pattern = q.get("pattern")
    return _page(names.where(selection.of_kind(q.get("kind")) & selection.matching(pattern and f"(?i){pattern}", "metric")), q, ["metric"])


def _frame_series(capture: Capture, q: dict) -> DataFrame:
    """Frames with the gap before each and the statistics of chosen metrics in it; a frame has a row for each metric."""
    c = capture
    frames = _need(c.frames, "frames")
    paced = intervals.frame_pacing(frames).select("id", "start_ns", "duration_ns", "gap_ns")
    rows = _need(c.metric_samples, "metric samples").where(F.col("metric").isin(list(q.get("metrics", ()))))
    stats = statistics.overlap_statistics(frames.select("id", "start_ns", "end_ns"), _need(c.samples, "samples"), rows)
    return _page(paced.join(stats.select("id", "metric", "mean", "p95", "coverage_pct"), "id", "left"), q, ["start_ns", "id", "metric"])


def _ranked(capture: Capture, q: dict) -> DataFrame:
    """Scopes of a kind by a statistic of one metric."""
    if "kind" not in q or "metric" not in q:
        raise QueryError("kind and metric are required")
    c = capture
    found = selection.scopes_query(_index(c)["scopes"], q["kind"], q.get("pattern")).where("start_ns is not null").select("id", "start_ns", "end_ns")
    stats = statistics.overlap_statistics(found, _need(c.samples, "samples"), _need(c.metric_samples, "metric samples").where(F.col("metric") == q["metric"]))
    return ranking.rank_scopes(stats, q.get("statistic", "mean"), q.get("descending", True), _most(q, "top", 8))


#: Sub-queries by type, from a capture and the query's arguments.
QUERY_TYPES = {
    "calls": _calls,
    "timings": _timings,
    "scopes": _scopes,
    "inspect_scope": _inspect,
    "action_states": lambda c, q: _page(selection.actions_query(_states(c), q.get("kind"), q.get("pattern")), q, [*streams.STREAM, "call_index"]),
    "counter_samples": lambda c, q: _page(c.samples, q, ["range_index"]),
    "metric_scan": lambda c, q: _page(statistics.metric_scan(c.metric_samples), q, ["metric"]),
    "metric_evaluation": lambda c, q: metric_evaluation(c, q.get("metrics", ()), q.get("patterns", ()), q.get("scopes", ())),
    "debug_groups": lambda c, q: _page(streams.debug_groups(c.calls), q, [*streams.STREAM, "sequence"]),
    "frames": lambda c, q: _page(intervals.frame_summary(c.frames), q, [F.lit(1)]),
    "scope_counts": lambda c, q: scope_tables.scope_counts(c.calls, _index(c)["buckets"], _index(c)["groups"], c.frames, c.nvtx),
    "workload": lambda c, q: streams.workload_summary(c.calls),
    "capture_quality": _quality,
    "timeline": lambda c, q: intervals.lane_timeline(_lanes(c), streams.STREAM, q.get("min_gap_ns", 1000)),
    "timeline_gaps": lambda c, q: intervals.top_gaps(_lanes(c), streams.STREAM, q.get("min_gap_ns", 1000), _most(q, "max_gaps", 20)),
    "action_state": lambda c, q: QUERY_TYPES["action_states"](c, q),
    "metric_discovery": _discovery,
    "frame_series": _frame_series,
    "scope_ranking": _ranked,
    "scope_evidence": lambda c, q: scope_evidence(c, q["scope"])["evidence"],
    "artifact_inventory": lambda c, q: _page(selection.artifacts_query(_need(c.artifacts, "artifacts"), q.get("pattern")), q, ["path"]),
    "artifact_read": lambda c, q: selection.read_artifact(_need(c.artifacts, "artifacts"), q["path"], q.get("offset", 0), q.get("limit", 4096)),
    "shader_inventory": lambda c, q: _page(shaders.shader_inventory(_need(c.shaders, "shaders"), q.get("pattern"), q.get("device")), q, ["position"]),
}


def query_capture(capture: Capture, queries: list[dict]) -> list[dict]:
    """From 1 to 16 typed sub-queries: their position, type and rows. An unknown type is an error before any is made."""
    if not 1 <= len(queries) <= MOST_QUERIES:
        raise QueryError(f"from 1 to {MOST_QUERIES} queries, not {len(queries)}")
    for k, q in enumerate(queries):
        if q.get("type") not in QUERY_TYPES:
            raise QueryError(f"queries[{k}] has unsupported type {q.get('type')!r}")
    out = []
    for k, q in enumerate(queries):
        try:
            out.append({"index": k, "type": q["type"], "data": QUERY_TYPES[q["type"]](capture, q)})
        except (QueryError, ScopeError, KeyError) as problem:
            raise QueryError(f"queries[{k}] ({q['type']}): {problem}") from problem
    return out


def metric_evaluation(capture: Capture, metrics=(), patterns=(), scopes=()) -> DataFrame:
    """Statistics of chosen metrics in each of the scopes (ids), or over the whole capture without scopes.

    Names given come first, then what patterns find among the collected metrics; names
    that the capture doesn't have give rows without values.
    """
    if not metrics and not patterns:
        raise QueryError("metric_evaluation requires metrics, patterns, or both")
    if len(metrics) > MOST_METRICS or len(patterns) > MOST_PATTERNS or len(scopes) > MOST_SCOPES:
        raise QueryError(f"at most {MOST_METRICS} metrics, {MOST_PATTERNS} patterns and {MOST_SCOPES} scopes")
    c = capture
    hit = F.col("metric").isin(list(metrics))
    for p in patterns:
        hit = hit | F.col("metric").rlike(f"(?i){p}")
    rows = c.metric_samples.where(hit)
    if scopes:
        chosen = _index(c)["scopes"].where(F.col("id").isin(list(scopes)))
    else:
        chosen = time_scope(parse_scope("capture"), c.samples)
    return statistics.overlap_statistics(chosen.where("start_ns is not null").select("id", "start_ns", "end_ns"), c.samples, rows)


def inspect_scope(capture: Capture, scope: str) -> dict[str, DataFrame]:
    """A scope's row, its calls, what they are, the marker ranges in it and, if it is one over time, its timing buckets."""
    at = _index(capture)
    row = at["scopes"].where(F.col("id") == scope)
    if row.isEmpty():
        raise QueryError(f"unknown scope ID {scope!r}")
    of = scope_tables.calls_of(row, capture.calls, at["buckets"])
    spans = at["buckets"].where("start_ns is not null").select("index", F.col("start_ns").alias("b_start"), F.col("end_ns").alias("b_end"))
    timed = row.where("call_start is null").select("id", "start_ns", "end_ns")
    return {
        "scope": row, "calls": of.orderBy("global_index").limit(scope_tables.MOST_LISTED), "evidence": scope_tables.call_evidence(of),
        "children": scope_tables.child_groups(at["groups"]).where(F.col("id") == scope),
        "timing_buckets": overlap_join(timed, spans, ("start_ns", "end_ns"), ("b_start", "b_end")).orderBy("index").limit(scope_tables.MOST_LISTED),
    }


def scope_evidence(capture: Capture, scope: str, metrics=(), patterns=(), states: int = 20) -> dict[str, DataFrame]:
    """``inspect_scope`` with the scope's first action states and its metrics."""
    out = inspect_scope(capture, scope)
    offsets = scope_tables.stream_offsets(capture.calls)
    placed = _states(capture).join(offsets, streams.STREAM).withColumn("global_index", F.col("base") + F.col("call_index"))
    of = scope_tables.calls_of(out["scope"], capture.calls, _index(capture)["buckets"])
    out["action_states"] = scope_tables.states_of(of, placed, states)
    if metrics or patterns:
        out["metrics"] = metric_evaluation(capture, metrics, patterns, [scope])
    return out


def overview(capture: Capture) -> dict[str, DataFrame]:
    """Counts of the capture, its commonest calls, its frames and its 20 longest buckets."""
    at = _index(capture)
    return {
        "calls": streams.workload_summary(capture.calls), "histogram": streams.call_histogram(capture.calls),
        "scopes": scope_tables.scope_counts(capture.calls, at["buckets"], at["groups"], capture.frames, capture.nvtx),
        "longest": ranking.longest_buckets(at["buckets"], ["index"]), "frames": capture.frames,
    }


def report(capture: Capture) -> dict[str, object]:
    """Overview, and all of ``analyze``: quality, timeline, scan and diagnostics."""
    whole = analyze(capture)
    return {"overview": overview(capture), "unavailable": whole.unavailable} | whole.sections
