"""The registered queries of the trace operators, and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import compare as C
from .operators import diagnostics as D
from .operators import intervals as I
from .operators import quality as Q
from .operators import ranking as R
from .operators import statistics as T
from .operators import streams as ST
from .operators.overlap import attach_samples, overlap_join
from .operators.state import action_states
from .sources import substrate as sub
from .sources.substrate import STREAM, table

MIN_GAP = 3_600_000_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def oracle(name: str, sql: str, *parts: str) -> None:
    """Register SQL, with the common table expressions that ``parts`` name before it."""
    ORACLES[name] = ("WITH " + ",\n".join(PARTS[p] for p in parts) + "\n" if parts else "") + sql


PARTS = {
    "ev": "ev AS (SELECT event_id, epoch_us(ts) * 1000 AS start_ns, user_id, event_type, value, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)",
    "s": """s AS (SELECT event_id AS range_index, start_ns, lead(start_ns) OVER (ORDER BY event_id) AS end_ns, event_type, value, k FROM ev)""",
    "samples": """samples AS (SELECT *, end_ns IS NOT NULL AND event_type <> 'signup' AS timestamp_valid, event_type <> 'error' AS complete, end_ns - start_ns AS duration_ns FROM s)""",
    "ms": """ms AS (
        SELECT range_index, start_ns, end_ns, timestamp_valid, duration_ns, 'sm__throughput.avg.pct_of_peak_sustained_elapsed' AS metric,
               CASE WHEN event_type <> 'error' THEN least(value, CAST(100 AS DOUBLE)) END AS v FROM samples
        UNION ALL
        SELECT range_index, start_ns, end_ns, timestamp_valid, duration_ns, 'lts__hit_rate.ratio',
               CASE WHEN event_type <> 'error' THEN k / CAST(100 AS DOUBLE) END FROM samples)""",
    "frames": """frames AS (SELECT DISTINCT 'frame:' || CAST(start_ns // 86400000000000 AS VARCHAR) AS id, start_ns // 86400000000000 AS frame_index,
               start_ns // 86400000000000 * 86400000000000 AS start_ns, (start_ns // 86400000000000 + 1) * 86400000000000 AS end_ns FROM ev)""",
    "slices": """slices AS (
        SELECT f.id, f.start_ns, f.end_ns, min(s.range_index) AS sample_start, max(s.range_index) + 1 AS sample_stop
        FROM frames f JOIN samples s ON s.timestamp_valid AND s.start_ns < f.end_ns AND s.end_ns > f.start_ns GROUP BY ALL)""",
    "rows": """rows_ AS (
        SELECT l.id, m.metric, m.range_index, m.v, least(l.end_ns, m.end_ns) - greatest(l.start_ns, m.start_ns) AS w
        FROM slices l JOIN ms m ON m.range_index >= l.sample_start AND m.range_index < l.sample_stop
        WHERE least(l.end_ns, m.end_ns) - greatest(l.start_ns, m.start_ns) > 0 AND m.v IS NOT NULL)""",
    "mids": """mids AS (
        SELECT *, sum(w) OVER (PARTITION BY id, metric ORDER BY v, range_index ROWS UNBOUNDED PRECEDING) - w / CAST(2 AS DOUBLE) AS mid,
               sum(w) OVER (PARTITION BY id, metric) AS tot FROM rows_),
        prev AS (SELECT *, lag(mid) OVER o AS pm, lag(v) OVER o AS pv, lead(mid) OVER o IS NULL AS fin FROM mids WINDOW o AS (PARTITION BY id, metric ORDER BY v, range_index)),
        pct AS (SELECT id, metric,
               coalesce(max(CASE WHEN mid >= tot * CAST(0.5 AS DOUBLE) AND (pm IS NULL OR pm < tot * CAST(0.5 AS DOUBLE)) THEN CASE WHEN pm IS NOT NULL AND mid > pm THEN pv + (v - pv) * ((tot * CAST(0.5 AS DOUBLE) - pm) / (mid - pm)) ELSE v END END), max(CASE WHEN fin THEN v END)) AS p50,
               coalesce(max(CASE WHEN mid >= tot * CAST(0.95 AS DOUBLE) AND (pm IS NULL OR pm < tot * CAST(0.95 AS DOUBLE)) THEN CASE WHEN pm IS NOT NULL AND mid > pm THEN pv + (v - pv) * ((tot * CAST(0.95 AS DOUBLE) - pm) / (mid - pm)) ELSE v END END), max(CASE WHEN fin THEN v END)) AS p95
               FROM prev GROUP BY id, metric)""",
    "stats": """means AS (SELECT *, sum(v * w) OVER (PARTITION BY id, metric) / sum(w) OVER (PARTITION BY id, metric) AS mean FROM rows_),
        stats AS (
        SELECT l.id, metrics.metric, coalesce(any_value(g.n), 0) AS valid_samples, any_value(l.sample_stop - l.sample_start) AS selected_samples,
               least(CAST(100 AS DOUBLE), coalesce(any_value(g.w), 0) * CAST(100 AS DOUBLE) / any_value(l.end_ns - l.start_ns)) AS coverage_pct,
               any_value(g.mean) AS mean, any_value(g.stddev) AS stddev, any_value(g.lo) AS min, any_value(g.lo_at) AS min_index, any_value(g.hi) AS max, any_value(g.hi_at) AS max_index,
               any_value(p.p50) AS p50, any_value(p.p95) AS p95, any_value(g.total) AS sum
        FROM slices l CROSS JOIN (SELECT DISTINCT metric FROM ms) metrics
        LEFT JOIN (SELECT id, metric, count(*) AS n, sum(w) AS w, any_value(mean) AS mean, sqrt(sum(w * pow(v - mean, 2)) / sum(w)) AS stddev, min(v) AS lo,
                          arg_min(range_index, v * CAST(1e9 AS DOUBLE) + range_index * CAST(1e-3 AS DOUBLE)) AS lo_at, max(v) AS hi,
                          arg_max(range_index, v * CAST(1e9 AS DOUBLE) + range_index * CAST(1e-3 AS DOUBLE)) AS hi_at, sum(v) AS total FROM means GROUP BY id, metric) g
               ON g.id = l.id AND g.metric = metrics.metric
        LEFT JOIN pct p ON p.id = l.id AND p.metric = metrics.metric GROUP BY l.id, metrics.metric)""",
    "scan": """sr AS (SELECT *, CAST(CASE WHEN timestamp_valid THEN greatest(duration_ns, 1) ELSE 1 END AS BIGINT) AS w FROM ms),
        sm AS (SELECT *, sum(w) OVER (PARTITION BY metric ORDER BY v, range_index ROWS UNBOUNDED PRECEDING) - w / CAST(2 AS DOUBLE) AS mid, sum(w) OVER (PARTITION BY metric) AS tot FROM sr WHERE v IS NOT NULL),
        sp AS (SELECT *, lag(mid) OVER o AS pm, lag(v) OVER o AS pv, lead(mid) OVER o IS NULL AS fin FROM sm WINDOW o AS (PARTITION BY metric ORDER BY v, range_index)),
        sq AS (SELECT metric,
               coalesce(max(CASE WHEN mid >= tot * CAST(0.5 AS DOUBLE) AND (pm IS NULL OR pm < tot * CAST(0.5 AS DOUBLE)) THEN CASE WHEN pm IS NOT NULL AND mid > pm THEN pv + (v - pv) * ((tot * CAST(0.5 AS DOUBLE) - pm) / (mid - pm)) ELSE v END END), max(CASE WHEN fin THEN v END)) AS p50,
               coalesce(max(CASE WHEN mid >= tot * CAST(0.95 AS DOUBLE) AND (pm IS NULL OR pm < tot * CAST(0.95 AS DOUBLE)) THEN CASE WHEN pm IS NOT NULL AND mid > pm THEN pv + (v - pv) * ((tot * CAST(0.95 AS DOUBLE) - pm) / (mid - pm)) ELSE v END END), max(CASE WHEN fin THEN v END)) AS p95
               FROM sp GROUP BY metric),
        scan AS (SELECT metric, count(*) AS selected_samples, count(v) AS valid_samples, count(CASE WHEN v <> 0 THEN 1 END) AS nonzero_samples, avg(v) AS sample_mean,
               sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END) AS time_weighted_mean, min(v) AS min, max(v) AS max, stddev_pop(v) AS stddev,
               arg_max(range_index, CASE WHEN v IS NOT NULL THEN v * CAST(1e9 AS DOUBLE) - range_index * CAST(1e-3 AS DOUBLE) END) AS peak_sample_index,
               any_value(p50) AS p50, any_value(p95) AS p95, count(v) * CAST(100 AS DOUBLE) / count(*) AS sample_coverage_pct,
               CASE WHEN sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END) > 0 THEN any_value(p95) / (sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END)) END AS burst_ratio
               FROM sr JOIN sq USING (metric) GROUP BY metric)""",
    "calls": """c0 AS (SELECT CAST(0 AS BIGINT) AS device_index, user_id % 4 // 2 AS queue_index, user_id % 4 % 2 AS stream_index, start_ns, event_id, k,
               CASE event_type WHEN 'signup' THEN 'vkCmdBeginDebugUtilsLabelEXT' WHEN 'purchase' THEN 'vkCmdEndDebugUtilsLabelEXT' WHEN 'view' THEN 'vkCmdBindPipeline'
                    WHEN 'error' THEN 'vkCmdPipelineBarrier' ELSE ['vkCmdDraw', 'vkCmdDispatch', 'vkCmdCopyBuffer', 'vkCmdClearColorImage'][1 + k % 4] END AS name FROM ev),
        calls AS (SELECT *, row_number() OVER (PARTITION BY device_index, queue_index, stream_index ORDER BY event_id) - 1 AS call_index,
               row_number() OVER (ORDER BY device_index, queue_index, stream_index, event_id) - 1 AS global_index,
               count(*) OVER (PARTITION BY device_index, queue_index, stream_index) AS stream_calls,
               CASE name WHEN 'vkCmdDraw' THEN 'draw' WHEN 'vkCmdDispatch' THEN 'dispatch' WHEN 'vkCmdCopyBuffer' THEN 'copy' WHEN 'vkCmdClearColorImage' THEN 'clear'
                    WHEN 'vkCmdPipelineBarrier' THEN 'sync' WHEN 'vkCmdBindPipeline' THEN 'other' ELSE 'marker' END AS kind FROM c0)""",
    "buckets": """bd AS (SELECT device_index, queue_index, stream_index, call_index, start_ns, row_number() OVER (PARTITION BY device_index, queue_index, stream_index ORDER BY call_index) - 1 AS i FROM calls WHERE name = 'vkCmdPipelineBarrier'),
        buckets AS (SELECT device_index, queue_index, stream_index, i AS bucket_index, call_index AS first_call, lead(call_index) OVER o AS next_call, lead(call_index) OVER o - call_index AS call_count,
               start_ns, lead(start_ns) OVER o AS end_ns, lead(start_ns) OVER o - start_ns AS max_duration_ns FROM bd WINDOW o AS (PARTITION BY device_index, queue_index, stream_index ORDER BY i) QUALIFY next_call IS NOT NULL)""",
    "iv": """iv AS (SELECT l_suppkey AS lane, epoch_us(l_shipdate) * 1000 AS start_ns, epoch_us(l_shipdate) * 1000 + CAST(l_quantity AS BIGINT) * 60000000000 AS end_ns FROM lineitem)""",
    "merged": """mf AS (SELECT *, CASE WHEN max(end_ns) OVER (PARTITION BY lane ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_ns THEN 0 ELSE 1 END AS nw FROM iv WHERE end_ns > start_ns),
        mi AS (SELECT *, sum(nw) OVER (PARTITION BY lane ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING) AS isl FROM mf),
        merged AS (SELECT lane, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM mi GROUP BY lane, isl)""",
    "gaps": """gaps AS (SELECT lane, end_ns AS gap_start, lead(start_ns) OVER o AS gap_end, lead(start_ns) OVER o - end_ns AS gap_ns FROM merged WINDOW o AS (PARTITION BY lane ORDER BY start_ns) QUALIFY gap_end IS NOT NULL)""",
}
SCOPED = ("ev", "s", "samples", "ms", "frames", "slices", "rows", "mids", "stats")
SCANNED = ("ev", "s", "samples", "ms", "scan")
STREAMS = ("ev", "calls")
LANES = ("iv", "merged", "gaps")
KEYS = "device_index, queue_index, stream_index"


# scopes and samples


@query
def scope_overlap_stats(spark: SparkSession, sf: str) -> DataFrame:
    return T.overlap_statistics(sub.frames(spark, sf), sub.samples(spark, sf), sub.metric_samples(spark, sf), width=sub.DAY_NS // 4)


oracle("scope_overlap_stats", "SELECT * FROM stats", *SCOPED)


@query
def scope_sample_slices(spark: SparkSession, sf: str) -> DataFrame:
    return attach_samples(sub.frames(spark, sf), sub.samples(spark, sf), width=sub.DAY_NS // 4).select("id", "sample_start", "sample_stop")


oracle("scope_sample_slices", "SELECT id, sample_start, sample_stop FROM slices", *SCOPED[:6])


@query
def metric_scan(spark: SparkSession, sf: str) -> DataFrame:
    return T.metric_scan(sub.metric_samples(spark, sf))


oracle("metric_scan", "SELECT * FROM scan", *SCANNED)


@query
def scan_header(spark: SparkSession, sf: str) -> DataFrame:
    return T.scan_header(sub.samples(spark, sf))


oracle(
    "scan_header",
    """SELECT count(*) AS selected_samples, count(CASE WHEN timestamp_valid THEN 1 END) AS timestamped_samples, count(CASE WHEN complete THEN 1 END) AS complete_samples,
       CAST(sum(CASE WHEN timestamp_valid THEN duration_ns END) AS BIGINT) AS sample_duration_ns FROM samples""",
    *SCANNED[:3],
)


@query
def metric_discovery(spark: SparkSession, sf: str) -> DataFrame:
    m = sub.metric_samples(spark, sf).select("metric").distinct()
    base = F.regexp_extract("metric", r"^([^.]*)", 1)
    m = m.withColumns({"base": base, "kind": S.metric_kind(F.col("metric"))}).where(F.col("base").rlike("(?i)THROUGHPUT|hit"))
    return m.select("metric", "base", "kind", S.metric_name(F.col("base"), F.col("kind")).alias("canonical"), S.unit_hint(F.col("metric"), F.col("kind")).alias("unit"), S.metric_category(F.col("base")).alias("category"), S.metric_priority(F.col("kind"), F.col("base")).alias("priority"))


oracle(
    "metric_discovery",
    """SELECT DISTINCT metric, split_part(metric, '.', 1) AS base, CASE WHEN metric LIKE '%throughput%' THEN 'throughput' ELSE 'ratio' END AS kind, metric AS canonical,
       CASE WHEN metric LIKE '%throughput%' THEN 'percent_of_peak' ELSE 'ratio' END AS unit, CASE WHEN metric LIKE 'sm%' THEN 'shader' ELSE 'memory_l2' END AS category,
       CASE WHEN metric LIKE '%throughput%' THEN 4 ELSE 3 END AS priority FROM ms WHERE metric LIKE '%throughput%' OR metric LIKE '%hit%'""",
    *SCANNED[:4],
)


@query
def scope_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return R.rank_scopes(scope_overlap_stats(spark, sf), "p95", top=8)


oracle("scope_ranking", "SELECT metric, id, p95 AS value, row_number() OVER (PARTITION BY metric ORDER BY p95 DESC, id) AS rank FROM stats WHERE p95 IS NOT NULL QUALIFY rank <= 8", *SCOPED)


@query
def region_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return R.rank_regions(sub.frames(spark, sf), scope_overlap_stats(spark, sf), metric_scan(spark, sf), top=12)


oracle(
    "region_ranking",
    """, r AS (SELECT t.id, max(CASE WHEN c.p95 > 0 THEN t.mean / c.p95 END) AS pressure,
            max(CASE WHEN c.stddev > 0 THEN least(CAST(10 AS DOUBLE), abs((t.mean - c.time_weighted_mean) / c.stddev)) END) AS anomaly FROM stats t JOIN scan c USING (metric) WHERE t.mean IS NOT NULL GROUP BY t.id),
       d AS (SELECT f.id, f.end_ns - f.start_ns AS duration_ns, pressure, anomaly, (f.end_ns - f.start_ns) / CAST(max(f.end_ns - f.start_ns) OVER () AS DOUBLE) AS d,
            least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), coalesce(pressure, 0))) AS p, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), coalesce(anomaly, 0) / CAST(5 AS DOUBLE))) AS a FROM frames f LEFT JOIN r USING (id))
       SELECT id, duration_ns, pressure, anomaly, CAST(0.45 AS DOUBLE) * d + CAST(0.35 AS DOUBLE) * p + CAST(0.20 AS DOUBLE) * a AS score,
            CASE WHEN pressure IS NULL AND anomaly IS NULL THEN 'duration' WHEN p >= d AND p >= a THEN 'metric_pressure' WHEN a > d THEN 'metric_anomaly' ELSE 'duration' END AS reason
       FROM d ORDER BY score DESC, duration_ns DESC, id LIMIT 12""",
    *SCOPED, "scan",
)


@query
def frame_series(spark: SparkSession, sf: str) -> DataFrame:
    p = I.frame_pacing(sub.frames(spark, sf)).select("id", "frame_index", "duration_ns", "gap_ns")
    stats = scope_overlap_stats(spark, sf).where(F.col("metric") == sub.THROUGHPUT).select("id", "mean", "coverage_pct")
    return p.join(stats, "id", "left")


oracle(
    "frame_series",
    f"""SELECT f.id, frame_index, f.end_ns - f.start_ns AS duration_ns, greatest(f.start_ns - lag(f.end_ns) OVER (ORDER BY f.start_ns, f.end_ns, f.id), 0) AS gap_ns, t.mean, t.coverage_pct
       FROM (SELECT f.* FROM frames f) f LEFT JOIN (SELECT * FROM stats WHERE metric = '{sub.THROUGHPUT}') t ON t.id = f.id""",
    *SCOPED,
)
ORACLES["frame_series"] = ORACLES["frame_series"].replace("greatest(f.start_ns - lag(f.end_ns) OVER (ORDER BY f.start_ns, f.end_ns, f.id), 0)", "CASE WHEN lag(f.end_ns) OVER (ORDER BY f.start_ns, f.end_ns, f.id) IS NOT NULL THEN greatest(f.start_ns - lag(f.end_ns) OVER (ORDER BY f.start_ns, f.end_ns, f.id), 0) END")


@query
def frame_summary(spark: SparkSession, sf: str) -> DataFrame:
    return I.frame_summary(sub.frames(spark, sf))


oracle(
    "frame_summary",
    """, p AS (SELECT *, end_ns - start_ns AS duration_ns, start_ns - lag(end_ns) OVER (ORDER BY start_ns, end_ns, id) AS g FROM frames)
       SELECT count(*) AS frames, max(end_ns) - min(start_ns) AS span_ns, CAST(round(quantile_cont(duration_ns, 0.5)) AS BIGINT) AS duration_p50, CAST(round(quantile_cont(duration_ns, 0.95)) AS BIGINT) AS duration_p95,
       max(duration_ns) AS duration_max, CAST(round(quantile_cont(greatest(g, 0), 0.5) FILTER (g IS NOT NULL)) AS BIGINT) AS gap_p50, CAST(round(quantile_cont(greatest(g, 0), 0.95) FILTER (g IS NOT NULL)) AS BIGINT) AS gap_p95,
       max(greatest(g, 0)) FILTER (g IS NOT NULL) AS gap_max, count(*) * CAST(1e9 AS DOUBLE) / (max(end_ns) - min(start_ns)) AS fps FROM p""",
    "ev", "frames",
)


# intervals and lanes


@query
def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    return I.merge_intervals(sub.intervals(spark, sf), ["lane"])


oracle("interval_merge", "SELECT * FROM merged", *LANES[:2])


@query
def lane_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return I.lane_timeline(sub.intervals(spark, sf), ["lane"], MIN_GAP)


oracle(
    "lane_timeline",
    f"""SELECT m.lane, first_ns, last_ns, busy_ns, last_ns - first_ns - busy_ns AS gap_ns, unions, coalesce(g.gaps, 0) AS gaps, g.longest_gap_ns
       FROM (SELECT lane, min(start_ns) AS first_ns, max(end_ns) AS last_ns, CAST(sum(end_ns - start_ns) AS BIGINT) AS busy_ns, count(*) AS unions FROM merged GROUP BY lane) m
       LEFT JOIN (SELECT lane, count(*) AS gaps, max(gap_ns) AS longest_gap_ns FROM gaps WHERE gap_ns >= {MIN_GAP} GROUP BY lane) g USING (lane)""",
    *LANES,
)


@query
def top_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return I.top_gaps(sub.intervals(spark, sf), ["lane"], MIN_GAP, 3)


oracle("top_gaps", f"SELECT lane, gap_start, gap_end, gap_ns, row_number() OVER (PARTITION BY lane ORDER BY gap_ns DESC, gap_start) AS rank FROM gaps WHERE gap_ns >= {MIN_GAP} QUALIFY rank <= 3", *LANES)


@query
def global_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return I.global_timeline(sub.intervals(spark, sf), ["lane"], MIN_GAP)


oracle(
    "global_timeline",
    f""", uf AS (SELECT *, CASE WHEN max(end_ns) OVER (ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_ns THEN 0 ELSE 1 END AS nw2 FROM merged),
       ui AS (SELECT *, sum(nw2) OVER (ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING) AS isl2 FROM uf),
       un AS (SELECT min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM ui GROUP BY isl2),
       ug AS (SELECT end_ns AS gap_start, lead(start_ns) OVER (ORDER BY start_ns) - end_ns AS gap_ns FROM un)
       SELECT min(start_ns) AS start_ns, max(end_ns) AS end_ns, CAST(sum(end_ns - start_ns) AS BIGINT) AS union_busy_ns, (SELECT CAST(sum(end_ns - start_ns) AS BIGINT) FROM merged) AS summed_busy_ns,
       (SELECT count(*) FROM ug WHERE gap_ns >= {MIN_GAP}) AS gaps, (SELECT max(gap_ns) FROM ug WHERE gap_ns >= {MIN_GAP}) AS longest_gap_ns,
       (SELECT gap_start FROM ug WHERE gap_ns >= {MIN_GAP} ORDER BY gap_ns DESC, gap_start DESC LIMIT 1) AS longest_gap_start_ns,
       (SELECT CAST(sum(end_ns - start_ns) AS BIGINT) FROM merged) - CAST(sum(end_ns - start_ns) AS BIGINT) AS overlap_ns,
       (SELECT CAST(sum(end_ns - start_ns) AS DOUBLE) FROM merged) / CAST(sum(end_ns - start_ns) AS DOUBLE) AS parallelism FROM un""",
    *LANES[:2],
)


@query
def interval_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Merged lane intervals against weeks: overlap time by week and lane."""
    lanes = I.merge_intervals(sub.intervals(spark, sf), ["lane"]).withColumnsRenamed({"start_ns": "i_start", "end_ns": "i_end"})
    week = F.lit(7 * sub.DAY_NS)
    weeks = sub.intervals(spark, sf).select(F.floor(F.col("start_ns") / week).alias("id")).distinct()
    weeks = weeks.select("id", (F.col("id") * week).alias("start_ns"), ((F.col("id") + 1) * week).alias("end_ns"))
    hits = overlap_join(weeks, lanes, ("start_ns", "end_ns"), ("i_start", "i_end"), width=sub.DAY_NS)
    return hits.groupBy("id", "lane").agg(F.count("*").alias("pairs"), F.sum(F.least("end_ns", "i_end") - F.greatest("start_ns", "i_start")).alias("overlap_ns"))


oracle(
    "interval_overlap_pairs",
    """, f AS (SELECT DISTINCT start_ns // 604800000000000 AS id, start_ns // 604800000000000 * 604800000000000 AS start_ns, (start_ns // 604800000000000 + 1) * 604800000000000 AS end_ns FROM iv)
       SELECT f.id, m.lane, count(*) AS pairs, CAST(sum(least(f.end_ns, m.end_ns) - greatest(f.start_ns, m.start_ns)) AS BIGINT) AS overlap_ns
       FROM f JOIN merged m ON m.start_ns < f.end_ns AND m.end_ns > f.start_ns GROUP BY f.id, m.lane""",
    *LANES[:2],
)


# command streams


@query
def call_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return ST.call_histogram(sub.calls(spark, sf))


oracle("call_histogram", "SELECT name, count(*) AS calls, any_value(kind) AS kind FROM calls GROUP BY name", *STREAMS)


@query
def call_query(spark: SparkSession, sf: str) -> DataFrame:
    """Draw-like calls by kind or a pattern of their name, one page in capture order."""
    c = sub.calls(spark, sf).where((F.col("kind") == "draw") | F.col("name").rlike("(?i)DISPATCH"))
    return c.select("global_index", *STREAM, "call_index", "name", "kind").orderBy("global_index").offset(20).limit(50)


oracle("call_query", f"SELECT global_index, {KEYS}, call_index, name, kind FROM calls WHERE kind IN ('draw', 'dispatch') ORDER BY global_index LIMIT 50 OFFSET 20", *STREAMS)


@query
def action_index(spark: SparkSession, sf: str) -> DataFrame:
    return ST.actions(sub.calls(spark, sf)).select("global_index", "action_index", "name", "kind")


oracle("action_index", "SELECT global_index, row_number() OVER (ORDER BY global_index) - 1 AS action_index, name, kind FROM calls WHERE kind <> 'marker'", *STREAMS)


@query
def debug_groups(spark: SparkSession, sf: str) -> DataFrame:
    return ST.debug_groups(sub.calls(spark, sf))


oracle(
    "debug_groups",
    f""", m AS (SELECT *, CASE WHEN name LIKE '%Begin%' THEN 1 ELSE -1 END AS d FROM calls WHERE kind = 'marker'),
       a AS (SELECT *, sum(d) OVER (PARTITION BY {KEYS} ORDER BY call_index ROWS UNBOUNDED PRECEDING) AS s FROM m),
       b AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY {KEYS} ORDER BY call_index ROWS UNBOUNDED PRECEDING)) AS dep FROM a),
       e AS (SELECT *, coalesce(lag(dep) OVER (PARTITION BY {KEYS} ORDER BY call_index), 0) AS bef FROM b),
       f AS (SELECT *, CASE WHEN d = 1 THEN bef ELSE dep END AS lvl FROM e WHERE d = 1 OR bef > 0),
       g AS (SELECT *, lead(call_index) OVER (PARTITION BY {KEYS}, lvl ORDER BY call_index) AS cls, row_number() OVER (PARTITION BY {KEYS}, d ORDER BY call_index) - 1 AS sequence FROM f),
       o AS (SELECT * FROM g WHERE d = 1)
       SELECT o.device_index, o.queue_index, o.stream_index, o.sequence, o.name, CAST(o.lvl AS BIGINT) AS depth, p.sequence AS parent, o.call_index AS call_start, coalesce(o.cls, o.stream_calls) AS call_stop, o.cls IS NOT NULL AS closed
       FROM o ASOF LEFT JOIN (SELECT device_index AS di, queue_index AS qi, stream_index AS si, lvl + 1 AS lv, call_index, sequence FROM o) p
         ON o.device_index = p.di AND o.queue_index = p.qi AND o.stream_index = p.si AND o.lvl = p.lv AND o.call_index > p.call_index""",
    *STREAMS,
)


@query
def timing_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return ST.timing_buckets(sub.boundaries(spark, sf))


oracle("timing_buckets", f"SELECT {KEYS}, bucket_index, first_call, next_call, call_count, 2 AS stage_count, max_duration_ns, start_ns, end_ns FROM buckets", *STREAMS, "buckets")


@query
def bucket_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return ST.bucket_kinds(timing_buckets(spark, sf), sub.calls(spark, sf))


oracle(
    "bucket_kinds",
    """SELECT b.device_index, b.queue_index, b.stream_index, bucket_index, c.kind, count(*) AS calls FROM buckets b JOIN calls c ON c.device_index = b.device_index AND c.queue_index = b.queue_index
       AND c.stream_index = b.stream_index AND c.call_index >= b.first_call AND c.call_index < b.next_call GROUP BY ALL""",
    *STREAMS, "buckets",
)


@query
def longest_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return R.longest_buckets(timing_buckets(spark, sf), [*STREAM, "bucket_index"]).select(*STREAM, "bucket_index", "max_duration_ns")


oracle("longest_buckets", f"SELECT {KEYS}, bucket_index, max_duration_ns FROM buckets ORDER BY max_duration_ns DESC NULLS LAST, {KEYS}, bucket_index LIMIT 20", *STREAMS, "buckets")


def _global_buckets(spark: SparkSession, sf: str) -> DataFrame:
    c = sub.calls(spark, sf).groupBy(*STREAM).agg(F.min(F.col("global_index") - F.col("call_index")).alias("base"))
    b = timing_buckets(spark, sf).join(c, STREAM)
    return b.withColumns({"first_global": F.col("base") + F.col("first_call"), "next_global": F.col("base") + F.col("next_call")})


@query
def scope_calls_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes of 64 consecutive calls: times from the buckets that they touch, and how exact those are."""
    n = F.floor(F.col("global_index") / 64)
    scopes = sub.calls(spark, sf).select((n * 64).alias("call_start")).distinct()
    scopes = scopes.select(F.concat(F.lit("calls:"), F.col("call_start").cast("string")).alias("id"), "call_start", (F.col("call_start") + 64).alias("call_stop"))
    return ST.scope_calls(scopes, _global_buckets(spark, sf), width=64)


oracle(
    "scope_calls_precision",
    f""", bb AS (SELECT {KEYS}, min(global_index - call_index) AS base FROM calls GROUP BY ALL),
       gb AS (SELECT b.*, base + first_call AS fg, base + next_call AS ng FROM buckets b JOIN bb USING (device_index, queue_index, stream_index)),
       sc AS (SELECT DISTINCT global_index // 64 * 64 AS call_start FROM calls),
       h AS (SELECT call_start, min(start_ns) AS start_ns, max(end_ns) AS end_ns, bool_or(fg < call_start OR ng > call_start + 64) AS shared, count(DISTINCT queue_index * 2 + stream_index) AS streams,
            CAST(sum(least(call_start + 64, ng) - greatest(call_start, fg)) AS BIGINT) AS covered FROM sc JOIN gb ON fg < call_start + 64 AND ng > call_start GROUP BY call_start)
       SELECT 'calls:' || CAST(call_start AS VARCHAR) AS id, call_start, call_start + 64 AS call_stop, start_ns, end_ns, coalesce(covered, 0) AS covered,
            CASE WHEN streams IS NULL THEN 'unavailable' WHEN streams > 1 THEN 'multi_stream_envelope' WHEN shared THEN 'bucket_shared' WHEN covered < 64 THEN 'partially_timestamped' ELSE 'timestamp_bounded' END AS precision
       FROM sc LEFT JOIN h USING (call_start)""",
    *STREAMS, "buckets",
)


@query
def covered_calls(spark: SparkSession, sf: str) -> DataFrame:
    return ST.covered_calls(timing_buckets(spark, sf), sub.calls(spark, sf), False)


oracle("covered_calls", "SELECT calls, covered, covered * CAST(100 AS DOUBLE) / calls AS coverage_pct FROM (SELECT count(*) AS calls FROM calls), (SELECT CAST(sum(call_count) AS BIGINT) AS covered FROM buckets)", *STREAMS, "buckets")


@query
def workload_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ST.workload_summary(sub.calls(spark, sf))


oracle(
    "workload_summary",
    """SELECT 'total' AS section, 'calls' AS name, count(*) AS value FROM calls UNION ALL SELECT 'total', 'actions', count(*) FROM calls WHERE kind <> 'marker'
       UNION ALL SELECT 'kind', kind, count(*) FROM calls GROUP BY kind UNION ALL SELECT 'device', CAST(device_index AS VARCHAR), count(*) FROM calls GROUP BY device_index
       UNION ALL (SELECT 'name', name, count(*) FROM calls GROUP BY name ORDER BY count(*) DESC, name LIMIT 20)""",
    *STREAMS,
)


@query
def action_state(spark: SparkSession, sf: str) -> DataFrame:
    return action_states(sub.calls(spark, sf).withColumnRenamed("k", "handle"))


oracle(
    "action_state",
    f""", st AS (SELECT *, last_value(CASE WHEN name = 'vkCmdBindPipeline' THEN k END IGNORE NULLS) OVER (PARTITION BY {KEYS} ORDER BY call_index ROWS UNBOUNDED PRECEDING) AS pipeline,
            coalesce(sum(CASE WHEN kind IN ('draw', 'dispatch', 'copy', 'clear', 'present') THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY call_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM calls),
       sg AS (SELECT {KEYS}, CAST(seg AS BIGINT) AS action_index, max(CASE WHEN kind IN ('draw', 'dispatch', 'copy', 'clear', 'present') THEN call_index END) AS call_index, count(CASE WHEN name = 'vkCmdBindPipeline' THEN 1 END) AS bindings,
            count(CASE WHEN kind = 'sync' THEN 1 END) AS barrier_count, list(call_index ORDER BY call_index) FILTER (kind = 'sync') AS bars FROM st GROUP BY ALL)
       SELECT {", ".join("sg." + k for k in STREAM)}, action_index, sg.call_index, st.name, st.kind, pipeline, bindings, barrier_count,
            CASE WHEN bars IS NULL THEN '[]' ELSE '[' || array_to_string(bars[greatest(1, len(bars) - 7):], ',') || ']' END AS recent_barriers
       FROM sg JOIN st USING (device_index, queue_index, stream_index, call_index)""",
    *STREAMS,
)


# quality and diagnostics


@query
def counter_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return Q.counter_coverage(sub.samples(spark, sf))


oracle(
    "counter_coverage",
    """, g AS (SELECT greatest(start_ns - lag(end_ns) OVER (ORDER BY range_index), 0) AS gap FROM samples WHERE timestamp_valid)
       SELECT count(*) AS populated_ranges, count(CASE WHEN complete THEN 1 END) AS completed_ranges, count(CASE WHEN timestamp_valid THEN 1 END) AS timestamped_ranges, CAST(sum(duration_ns) AS BIGINT) AS sample_duration_ns,
       (SELECT list(duration_ns ORDER BY duration_ns)[count(*) // 2 + 1] FROM samples WHERE duration_ns IS NOT NULL) AS median_sample_duration_ns, (SELECT nullif(max(gap), 0) FROM g) AS max_sample_gap_ns,
       count(CASE WHEN complete THEN 1 END) * CAST(100 AS DOUBLE) / count(*) AS complete_pct, count(CASE WHEN timestamp_valid THEN 1 END) * CAST(100 AS DOUBLE) / count(*) AS timestamped_pct FROM samples""",
    *SCANNED[:3],
)


def info_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of info tables: orders are settings by their priority, suppliers name the machine."""
    setting = F.when(F.col("o_orderpriority") == "1-URGENT", "GPU Clocks").when(F.col("o_orderpriority") == "3-MEDIUM", " V-Sync Mode").when(F.col("o_orderpriority") == "5-LOW", "Time Every Action").otherwise(F.col("o_orderpriority"))
    value = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("No")).otherwise(F.concat(F.lit("mode "), F.col("o_orderstatus"), F.lit(" ")))
    orders = table(spark, sf, "orders").select(F.lit(Q.SETTINGS).alias("table"), setting.alias("name"), value.alias("value"), F.col("o_orderkey").alias("ord"))
    machine = table(spark, sf, "supplier").select(F.lit("GPU"), F.when(F.col("s_nationkey") < 12, "Device Name").otherwise("Chip Name"), "s_name", "s_suppkey")
    return orders.union(machine)


@query
def capture_environment(spark: SparkSession, sf: str) -> DataFrame:
    """Machine, session and settings, the map as text."""
    got = Q.capture_environment(info_entries(spark, sf))
    return got.withColumn("settings", F.array_join(F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


PARTS["entries"] = """entries AS (SELECT 'Session Settings' AS tab, CASE o_orderpriority WHEN '1-URGENT' THEN 'GPU Clocks' WHEN '3-MEDIUM' THEN 'V-Sync Mode' WHEN '5-LOW' THEN 'Time Every Action' ELSE o_orderpriority END AS name,
               CASE o_orderpriority WHEN '5-LOW' THEN 'No' ELSE 'mode ' || o_orderstatus END AS value, o_orderkey AS ord FROM orders
        UNION ALL SELECT 'GPU', CASE WHEN s_nationkey < 12 THEN 'Device Name' ELSE 'Chip Name' END, s_name, s_suppkey FROM supplier),
        lasts AS (SELECT tab, name, arg_max(value, ord) AS value FROM entries GROUP BY tab, name)"""
oracle(
    "capture_environment",
    """SELECT CAST(NULL AS VARCHAR) AS computer, CAST(NULL AS VARCHAR) AS operating_system, (SELECT value FROM lasts WHERE name = 'Device Name') AS gpu, (SELECT value FROM lasts WHERE name = 'Chip Name') AS chip,
       CAST(NULL AS VARCHAR) AS driver, CAST(NULL AS VARCHAR) AS product_version, CAST(NULL AS VARCHAR) AS api, CAST(NULL AS VARCHAR) AS process, CAST(NULL AS VARCHAR) AS command_line,
       (SELECT string_agg(name || '=' || value, ';' ORDER BY name) FROM lasts WHERE tab = 'Session Settings') AS settings""",
    "entries",
)


@query
def quality_checks(spark: SparkSession, sf: str) -> DataFrame:
    """All checks of a capture, those of its machine and session included."""
    told = Q.capture_environment(info_entries(spark, sf))
    return Q.quality_checks(counter_coverage(spark, sf), covered_calls(spark, sf), timing_buckets(spark, sf), sub.frames(spark, sf), sub.samples(spark, sf), told)


def _threshold(code: str, label: str, value: str) -> str:
    state = f"CASE WHEN {value} >= 90 THEN 'pass' WHEN {value} < 50 THEN 'fail' ELSE 'warn' END"
    limit = f"CASE WHEN {value} >= 90 THEN '.' WHEN {value} < 50 THEN ' is below the usable threshold of 50%.' ELSE ' is below the preferred 90%.' END"
    return f"SELECT '{code}', {state}, printf('{label}: %.1f%%', {value}) || {limit} FROM y"


oracle(
    "quality_checks",
    f""", g AS (SELECT greatest(start_ns - lag(end_ns) OVER (ORDER BY range_index), 0) AS gap FROM samples WHERE timestamp_valid),
       x AS (SELECT count(CASE WHEN complete THEN 1 END) * CAST(100 AS DOUBLE) / count(*) AS c, count(CASE WHEN timestamp_valid THEN 1 END) * CAST(100 AS DOUBLE) / count(*) AS t,
             arg_min(CASE WHEN timestamp_valid THEN start_ns END, CASE WHEN timestamp_valid THEN range_index END) AS s0, arg_max(CASE WHEN timestamp_valid THEN end_ns END, CASE WHEN timestamp_valid THEN range_index END) AS s1 FROM samples),
       z AS (SELECT count(CASE WHEN call_count > 1 THEN 1 END) AS sh, count(*) AS n, CAST(sum(call_count) AS DOUBLE) AS cov, min(start_ns) AS b0, max(end_ns) AS b1 FROM buckets),
       y AS (SELECT *, cov * 100 / (SELECT count(*) FROM calls) AS p, (SELECT coalesce(max(gap), 0) FROM g) AS gap, (SELECT list(duration_ns ORDER BY duration_ns)[count(*) // 2 + 1] FROM samples WHERE duration_ns IS NOT NULL) AS med,
             (SELECT value FROM lasts WHERE name = 'GPU Clocks') AS clocks, (SELECT value FROM lasts WHERE name = 'V-Sync Mode') AS vs, (SELECT value FROM lasts WHERE name = 'Time Every Action') AS every FROM x, z),
       q AS (SELECT 'counter_image' AS code, 'pass' AS status, 'The capture holds counter samples.' AS message
             UNION ALL {_threshold("counter_completeness", "Completed periodic samples", "c")} UNION ALL {_threshold("counter_timestamps", "Timestamped periodic samples", "t")}
             UNION ALL SELECT 'counter_window_gaps', CASE WHEN gap > 4 * med THEN 'warn' ELSE 'pass' END, CASE WHEN gap > 4 * med THEN 'Samples are up to ' || gap || ' ns apart, more than four median samples.' ELSE 'Samples follow each other without wide gaps.' END FROM y
             UNION ALL SELECT 'counter_timing_window', CASE WHEN b0 < s0 OR b1 > s1 THEN 'warn' ELSE 'pass' END, CASE WHEN b0 < s0 OR b1 > s1 THEN 'Timing buckets begin before the samples or end after them.' ELSE 'The samples cover all timing buckets.' END FROM y
             UNION ALL {_threshold("call_timestamp_coverage", "Calls covered by timestamp buckets", "p")}
             UNION ALL SELECT 'action_attribution', CASE WHEN sh * 2 > n THEN 'warn' ELSE 'pass' END, sh || ' of ' || n || ' timing buckets hold several calls.' FROM y
             UNION ALL SELECT 'frame_markers', 'warn', 'There are no frames.' FROM y WHERE (SELECT count(*) FROM frames) = 0
             UNION ALL SELECT 'environment_identity', 'warn', 'The device or its driver isn''t named.' FROM y
             UNION ALL SELECT 'gpu_clocks', 'warn', 'Clocks aren''t locked: ' || clocks FROM y WHERE clocks IS NOT NULL UNION ALL SELECT 'vsync', 'warn', 'Frames wait for the display: ' || vs FROM y WHERE vs IS NOT NULL
             UNION ALL SELECT 'time_every_action', 'warn', 'Not every action was timed.' FROM y WHERE every IS NOT NULL)
       SELECT code, status, CASE status WHEN 'pass' THEN 0 WHEN 'warn' THEN 1 WHEN 'fail' THEN 2 ELSE 3 END AS rank, message FROM q""",
    "ev", "s", "samples", "frames", "calls", "buckets", "entries",
)


@query
def environment(spark: SparkSession, sf: str) -> DataFrame:
    """Nations and regions as entries of two tables, picked into columns; the last entry of a name counts."""
    r = table(spark, sf, "region").select(F.lit("Region").alias("table"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("value"), F.col("r_regionkey").alias("ord"))
    n = table(spark, sf, "nation").select(F.lit("Nation"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")), "n_name", "n_nationkey")
    return Q.environment(r.union(n), {"asia": ("Region", "ASIA"), "first_region": ("Nation", "region 0"), "third_region": ("Nation", "region 2"), "missing": ("Region", "NOWHERE")})


oracle(
    "environment",
    """SELECT (SELECT CAST(max(r_regionkey) AS VARCHAR) FROM region WHERE r_name = 'ASIA') AS asia, (SELECT arg_max(n_name, n_nationkey) FROM nation WHERE n_regionkey = 0) AS first_region,
       (SELECT arg_max(n_name, n_nationkey) FROM nation WHERE n_regionkey = 2) AS third_region, CAST(NULL AS VARCHAR) AS missing""",
)


@query
def category_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.category_summary(metric_scan(spark, sf))


oracle(
    "category_summary",
    """SELECT CASE WHEN metric LIKE 'sm%' THEN 'shader' ELSE 'memory_l2' END AS category, count(*) AS available, count(CASE WHEN nonzero_samples > 0 THEN 1 END) AS nonzero,
       coalesce(string_agg(CASE WHEN metric LIKE '%throughput%' THEN metric END, ','), '') AS top_throughputs FROM scan WHERE valid_samples > 0 GROUP BY 1""",
    *SCANNED,
)


@query
def pressure_findings(spark: SparkSession, sf: str) -> DataFrame:
    return D.findings(metric_scan(spark, sf))


oracle(
    "pressure_findings",
    """SELECT 'shader' AS category, metric, CASE WHEN time_weighted_mean >= 80 THEN 'high' WHEN time_weighted_mean >= 60 THEN 'medium' WHEN p95 >= 80 THEN 'high' ELSE 'medium' END AS severity,
       CASE WHEN time_weighted_mean >= 60 THEN 'sustained' ELSE 'burst' END AS rule, time_weighted_mean AS mean, p95 FROM scan
       WHERE metric LIKE '%throughput%' AND sample_coverage_pct >= 50 AND (time_weighted_mean >= 60 OR p95 >= 60)""",
    *SCANNED,
)


@query
def throughput_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return D.throughput_cluster(metric_scan(spark, sf))


oracle("throughput_cluster", "SELECT metric, p95 AS pressure, max(p95) OVER () - p95 AS behind FROM scan WHERE metric LIKE '%throughput%'", *SCANNED)


# comparison


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = sub.metric_samples(spark, sf)
    split = F.lit(1705363200_000_000_000)
    return m.where(F.col("start_ns") < split), m.where(F.col("start_ns") >= split)


_SIDE = """{0} AS (SELECT metric, sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END) AS mean, count(v) * CAST(100 AS DOUBLE) / count(*) AS coverage FROM
       (SELECT metric, v, CAST(CASE WHEN timestamp_valid THEN greatest(duration_ns, 1) ELSE 1 END AS BIGINT) AS w FROM ms WHERE start_ns {1} 1705363200000000000) GROUP BY metric HAVING count(v) > 0)"""


@query
def metric_delta(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (T.metric_scan(x) for x in _sides(spark, sf))
    return C.ranked_deltas(C.metric_deltas(a, b)).drop("p95_delta")


oracle(
    "metric_delta",
    f""", {_SIDE.format("a", "<")}, {_SIDE.format("b", ">=")}
       SELECT metric, a.mean AS mean_a, b.mean AS mean_b, b.mean - a.mean AS delta, (b.mean - a.mean) / nullif(a.mean, 0) * CAST(100 AS DOUBLE) AS relative_pct, b.coverage - a.coverage AS coverage_delta,
       CASE WHEN metric LIKE '%throughput%' THEN 4 ELSE 3 END AS priority FROM a JOIN b USING (metric)""",
    *SCANNED[:4],
)


@query
def scope_match(spark: SparkSession, sf: str) -> DataFrame:
    """Debug groups of two streams as baseline and candidate, by name and occurrence among the longest."""
    g = debug_groups(spark, sf).select("stream_index", "queue_index", F.col("name").alias("label"), F.concat_ws(":", "queue_index", "sequence").alias("id"), (F.col("call_stop") - F.col("call_start")).alias("duration_ns"))
    return C.match_scopes(g.where("stream_index = 0"), g.where("stream_index = 1"))


@query
def item_match(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of two sources as shaders of two captures, by language and occurrence."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return C.match_items(d.where("source = 'src0'"), d.where("source = 'src1'"), ["lang"], "doc_id", "n_chars").groupBy("lang", "change").agg(F.count("*").alias("items"))


oracle(
    "item_match",
    """WITH x AS (SELECT lang, n_chars, source, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS o FROM documents WHERE source IN ('src0', 'src1')),
       a AS (SELECT * FROM x WHERE source = 'src0'), b AS (SELECT * FROM x WHERE source = 'src1')
       SELECT coalesce(a.lang, b.lang) AS lang, CASE WHEN a.o IS NULL THEN 'added' WHEN b.o IS NULL THEN 'removed' WHEN a.n_chars = b.n_chars THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS items
       FROM a FULL OUTER JOIN b ON a.lang = b.lang AND a.o = b.o GROUP BY 1, 2""",
)


@query
def comparability(spark: SparkSession, sf: str) -> DataFrame:
    """Two markets' order priorities as settings."""
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("value"))
    other = n.select("name", F.when(F.col("value") == 2, None).otherwise(F.col("value") % 3).alias("value"))
    return C.comparability(n, other, ["CHINA", "FRANCE", "JAPAN"])


oracle(
    "comparability",
    """SELECT name, a, b, name IN ('CHINA', 'FRANCE', 'JAPAN') AS blocks FROM (SELECT n_name AS name, n_regionkey AS a, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey % 3 END AS b FROM nation) WHERE a IS DISTINCT FROM b""",
)


@query
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of the difference of both metrics' means between the events before and from the split, over daily means."""
    a, b = _sides(spark, sf)
    daily = lambda df, x: df.where("value is not null").groupBy("metric", F.floor(F.col("start_ns") / F.lit(sub.DAY_NS)).alias("order")).agg(F.avg("value").alias("value"), F.count("*").cast("double").alias("w")).withColumn("side", F.lit(x))
    return C.bootstrap(daily(a, "a").unionByName(daily(b, "b")))


# artifacts


@query
def artifact_inventory(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    p = table(spark, sf, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")), F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    return d.union(p).select("path", F.length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"), S.preview(F.col("content"), 8).alias("preview_hex"))


oracle(
    "artifact_inventory",
    """WITH a AS (SELECT 'documents/' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'pages/' || CAST(page_id AS VARCHAR), coalesce(html, '') FROM pages)
       SELECT path, CAST(strlen(t) AS BIGINT) AS size, sha256(t) AS sha256, lower(substr(hex(encode(t)), 1, 16)) AS preview_hex FROM a""",
)


@query
def largest_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return artifact_inventory(spark, sf).orderBy(F.desc("size"), "path").limit(5).select("path", "size")


oracle(
    "largest_artifacts",
    """WITH a AS (SELECT 'documents/' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'pages/' || CAST(page_id AS VARCHAR), coalesce(html, '') FROM pages)
       SELECT path, CAST(strlen(t) AS BIGINT) AS size FROM a ORDER BY size DESC, path LIMIT 5""",
)


@query
def occupancy_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as shaders: static occupancy by size and price."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 4).alias("registers"), (F.col("p_partkey") % 16 * 64 + 32).alias("threads"), (F.col("p_partkey") % 7 * 9000).alias("shared"))
    o = S.occupancy(F.when(F.col("p_partkey") % 2 == 0, 120).otherwise(86), F.col("registers"), F.col("threads"), F.col("shared"))
    return p.select("p_partkey", o.alias("o")).select("p_partkey", F.col("o.warps").cast("bigint").alias("warps"), "o.occupancy_pct", "o.limiting_factor")


oracle(
    "occupancy_estimates",
    """WITH p AS (SELECT p_partkey, p_size * 4 AS r, p_partkey % 16 * 64 + 32 AS t, p_partkey % 7 * 9000 AS s, CASE WHEN p_partkey % 2 = 0 THEN 1536 ELSE 2048 END AS mt, CASE WHEN p_partkey % 2 = 0 THEN 48 ELSE 64 END AS mw FROM part),
       w AS (SELECT *, least(65536 // (greatest(r, 1) * 32), mw) AS br, least(mt // t * ((t + 31) // 32), mw) AS bt, CASE WHEN s > 0 THEN least(greatest(233472 // s, 1) * ((t + 31) // 32), mw) END AS bs FROM p),
       v AS (SELECT *, least(br, bt, coalesce(bs, 999)) AS warps FROM w)
       SELECT p_partkey, CAST(warps AS BIGINT) AS warps, CAST(100 AS DOUBLE) * warps / mw AS occupancy_pct, CASE WHEN br = warps THEN 'registers' WHEN bt = warps THEN 'threads_per_block' ELSE 'shared_memory' END AS limiting_factor FROM v""",
)


@query
def view_filter_sort_page(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the event log by a value in their JSON, nulls last, one page."""
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "value")
    return e.where("k is not null and k >= 50").orderBy(F.col("value").desc_nulls_last(), "event_id").offset(10).limit(25)


oracle(
    "view_filter_sort_page",
    "SELECT event_id, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS k, value FROM events WHERE CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) >= 50 ORDER BY value DESC NULLS LAST, event_id LIMIT 25 OFFSET 10",
)
from . import capture_queries, detail_queries  # noqa: E402, F401  register their queries

for _name in list(ORACLES):
    ORACLES[_name] = ORACLES[_name].replace("\n, ", ",\n")


def _rounded(name: str, *columns: str) -> None:
    """Sums of doubles depend on their order: the registered query gives ``columns`` to six places, on both sides."""
    plain = QUERIES[name]
    QUERIES[name] = lambda spark, sf: plain(spark, sf).withColumns({c: F.round(c, 6) for c in columns})
    ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns)}) FROM (\n{ORACLES[name]}\n)"


_rounded("scope_overlap_stats", "coverage_pct", "mean", "stddev", "sum", "p50", "p95")
_rounded("scope_ranking", "value")
_rounded("frame_series", "mean", "coverage_pct")
_rounded("metric_scan", "sample_mean", "time_weighted_mean", "stddev", "p50", "p95", "burst_ratio")
_rounded("region_ranking", "pressure", "anomaly", "score")
_rounded("metric_delta", "mean_a", "mean_b", "delta", "relative_pct")
_rounded("pressure_findings", "mean", "p95")
_rounded("throughput_cluster", "pressure", "behind")
