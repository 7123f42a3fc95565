"""Registered queries over a capture's scopes, selections and comparisons, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compare as C
from .operators import diagnostics as D
from .operators import scope_tables as SC
from .operators import selection as SE
from .operators import shaders as SH
from .operators import statistics as T
from .operators import view
from .operators.state import action_states
from .plans import reports
from .queries import KEYS, ORACLES, PARTS, QUERIES, SCANNED, SCOPED, STREAMS, _sides, debug_groups, metric_scan, oracle, query, scope_overlap_stats, timing_buckets
from .sources import substrate as sub
from .sources.sinks import json_rows
from .sources.substrate import STREAM, table

PARTS |= {
    "gb": f"""bb AS (SELECT {KEYS}, min(global_index - call_index) AS base FROM calls GROUP BY ALL),
        gb AS (SELECT b.*, base + first_call AS fg, base + next_call AS ng, row_number() OVER (ORDER BY {KEYS}, bucket_index) - 1 AS index FROM buckets b JOIN bb USING ({KEYS}))""",
    "groups": f"""gm AS (SELECT *, CASE WHEN name LIKE '%Begin%' THEN 1 ELSE -1 END AS d FROM calls WHERE kind = 'marker'),
        gs AS (SELECT *, sum(d) OVER (PARTITION BY {KEYS} ORDER BY call_index ROWS UNBOUNDED PRECEDING) AS s FROM gm),
        gd AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY {KEYS} ORDER BY call_index ROWS UNBOUNDED PRECEDING)) AS dep FROM gs),
        ge AS (SELECT *, coalesce(lag(dep) OVER (PARTITION BY {KEYS} ORDER BY call_index), 0) AS bef FROM gd),
        gf AS (SELECT *, CASE WHEN d = 1 THEN bef ELSE dep END AS lvl FROM ge WHERE d = 1 OR bef > 0),
        gg AS (SELECT *, lead(call_index) OVER (PARTITION BY {KEYS}, lvl ORDER BY call_index) AS cls, row_number() OVER (PARTITION BY {KEYS}, d ORDER BY call_index) - 1 AS sequence FROM gf),
        groups AS (SELECT {KEYS}, sequence, name, lvl, call_index AS call_start, coalesce(cls, stream_calls) AS call_stop, cls IS NOT NULL AS closed FROM gg WHERE d = 1)""",
    "scopes": f"""fam AS (
        SELECT 'debug_group' AS kind, 'debug:' || device_index || ':' || queue_index || ':' || stream_index || ':' || sequence AS id, name AS label, base + call_start AS cs, base + call_stop AS ce,
               CASE WHEN NOT closed THEN 'Debug group is not closed in the capture.' END AS warning FROM groups JOIN bb USING ({KEYS})
        UNION ALL SELECT 'action', 'action:' || (row_number() OVER (ORDER BY global_index) - 1), name || ' (global call ' || global_index || ')', global_index, global_index + 1, NULL FROM calls WHERE kind <> 'marker'
        UNION ALL SELECT 'timing_bucket', 'bucket:' || index, 'timing bucket ' || index, fg, ng, NULL FROM gb),
        hits AS (SELECT f.kind, f.id, min(gb.start_ns) AS s, max(gb.end_ns) AS e, bool_or(fg < cs OR ng > ce) AS sh, count(DISTINCT queue_index * 2 + stream_index) AS st, sum(least(ce, ng) - greatest(cs, fg)) AS cov
                 FROM fam f JOIN gb ON fg < ce AND ng > cs GROUP BY f.kind, f.id),
        scopes AS (SELECT kind, id, label, s AS start_ns, e AS end_ns, cs AS call_start, ce AS call_stop,
                   CASE WHEN st IS NULL THEN 'unavailable' WHEN st > 1 THEN 'multi_stream_envelope' WHEN sh THEN 'bucket_shared' WHEN cov < ce - cs THEN 'partially_timestamped' ELSE 'timestamp_bounded' END AS precision, warning
                   FROM fam LEFT JOIN hits USING (kind, id)
                   UNION ALL SELECT 'frame', id, 'presented frame ' || frame_index, start_ns, end_ns, NULL, NULL, 'frame_timestamps', NULL FROM frames)""",
    "of": """cof AS (SELECT s.id, c.global_index, c.name, c.kind FROM scopes s JOIN calls c ON s.kind = 'timing_bucket' AND c.global_index >= s.call_start AND c.global_index < s.call_stop
        UNION ALL SELECT DISTINCT s.id, c.global_index, c.name, c.kind FROM scopes s JOIN gb ON s.kind = 'frame' AND gb.start_ns < s.end_ns AND gb.end_ns > s.start_ns JOIN calls c ON c.global_index >= fg AND c.global_index < ng)""",
    "described": """described AS (SELECT *, regexp_extract(metric, '^([^.]*)', 1) AS base, CASE WHEN metric LIKE '%.ratio' OR metric LIKE '%hit_rate%' THEN 'ratio' WHEN metric LIKE '%throughput%' THEN 'throughput' ELSE 'counter' END AS mkind FROM scan)""",
    "nvtx": """nvtx AS (SELECT 'nvtx:' || CASE l_linenumber WHEN 1 THEN 'push_pop' ELSE 'start_end' END || ':' || l_orderkey AS id, l_returnflag AS name,
        CASE WHEN l_quantity < 5 THEN 0 ELSE epoch_us(l_shipdate) * 1000 END AS start_ns, epoch_us(l_shipdate) * 1000 + (CAST(l_quantity AS BIGINT) - 10) * 1000000000 AS end_ns FROM lineitem WHERE l_linenumber IN (1, 2))""",
}
SCOPE_TABLE = ("ev", "calls", "buckets", "gb", "groups", "frames", "scopes")
SHIFT = -800_000_000 * 1_000_000_000


def _buckets(spark: SparkSession, sf: str) -> DataFrame:
    return SC.global_buckets(timing_buckets(spark, sf), sub.calls(spark, sf))


def _nvtx(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as profiler ranges: first lines were pushed and popped, second ones started and ended."""
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    rows = table(spark, sf, "lineitem").select("l_linenumber", F.col("l_orderkey").alias("position"), F.col("l_returnflag").alias("name"), F.when(F.col("l_quantity") >= 5, ns("l_shipdate")).alias("start"), (ns("l_shipdate") + (F.col("l_quantity").cast("bigint") - 10) * 1_000_000_000).alias("end"))
    return SC.nvtx_ranges(rows.where("l_linenumber = 1"), rows.where("l_linenumber = 2"))


# scopes


@query
def scope_table(spark: SparkSession, sf: str) -> DataFrame:
    return SC.scope_table(sub.calls(spark, sf), _buckets(spark, sf), sub.frames(spark, sf))


oracle("scope_table", "SELECT * FROM scopes", *SCOPE_TABLE)


@query
def scope_counts(spark: SparkSession, sf: str) -> DataFrame:
    return SC.scope_counts(sub.calls(spark, sf), timing_buckets(spark, sf), debug_groups(spark, sf), sub.frames(spark, sf), _nvtx(spark, sf))


oracle(
    "scope_counts",
    """SELECT 'debug_group' AS kind, count(*) AS scopes FROM groups UNION ALL SELECT 'nvtx_range', count(*) FROM nvtx UNION ALL SELECT 'frame', count(*) FROM frames
       UNION ALL SELECT 'action', count(*) FROM calls WHERE kind <> 'marker' UNION ALL SELECT 'timing_bucket', count(*) FROM buckets""",
    "ev", "calls", "buckets", "groups", "frames", "nvtx",
)


@query
def scopes_query(spark: SparkSession, sf: str) -> DataFrame:
    """Actions whose id or label matches, one page."""
    return SE.paged(SE.scopes_query(scope_table(spark, sf), "action", r"Dispatch|^action:7\d$").select("id", "label", "call_start", "precision"), ["call_start"], 5, 40)


oracle("scopes_query", "SELECT id, label, call_start, precision FROM scopes WHERE kind = 'action' AND (regexp_matches(id, 'Dispatch|^action:7\\d$') OR regexp_matches(label, 'Dispatch|^action:7\\d$')) ORDER BY call_start LIMIT 40 OFFSET 5", *SCOPE_TABLE)


@query
def scope_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes by ids of several families; one that doesn't exist gives no row."""
    wanted = spark.createDataFrame([("bucket:3",), ("action:11",), ("debug:0:1:0:2",), ("frame:19724",), ("bucket:99999999",)], "id string")
    return scope_table(spark, sf).join(F.broadcast(wanted), "id", "left_semi").drop("warning")


oracle("scope_by_id", "SELECT * EXCLUDE (warning) FROM scopes WHERE id IN ('bucket:3', 'action:11', 'debug:0:1:0:2', 'frame:19724', 'bucket:99999999')", *SCOPE_TABLE)


@query
def nvtx_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Profiler ranges on a clock shifted by the caller; those that can't be are errors."""
    return SC.shifted_nvtx(_nvtx(spark, sf), SHIFT)


oracle(
    "nvtx_scopes",
    f"""SELECT id, name, CASE WHEN error IS NULL THEN start_ns + {SHIFT} END AS start_ns, CASE WHEN error IS NULL THEN end_ns + {SHIFT} END AS end_ns, 'nvtx_clock_offset' AS precision, error
        FROM (SELECT *, CASE WHEN start_ns + {SHIFT} < 0 OR end_ns + {SHIFT} < 0 THEN 'clock offset underflows' WHEN end_ns <= start_ns THEN 'clock offset produces an empty range' END AS error FROM nvtx)""",
    "nvtx",
)


@query
def sample_scope(spark: SparkSession, sf: str) -> DataFrame:
    return SC.sample_scope(sub.samples(spark, sf), 20, 90)


oracle(
    "sample_scope",
    """SELECT 'samples:20..90' AS id, arg_min(start_ns, range_index) FILTER (timestamp_valid) AS start_ns, arg_max(end_ns, range_index) FILTER (timestamp_valid) AS end_ns,
       CAST(20 AS BIGINT) AS sample_start, CAST(90 AS BIGINT) AS sample_stop,
       CASE WHEN count(*) < 70 THEN 'beyond the capture''s samples' WHEN count(*) FILTER (timestamp_valid) < count(*) THEN count(*) FILTER (timestamp_valid) || ' of ' || count(*) || ' selected samples have valid timestamps.' END AS warning
       FROM samples WHERE range_index >= 20 AND range_index < 90""",
    *SCANNED[:3],
)


def _timed_scopes(spark: SparkSession, sf: str) -> DataFrame:
    b = _buckets(spark, sf)
    return SC.bucket_scopes(b).unionByName(SC.frame_scopes(sub.frames(spark, sf)))


def _calls_of(spark: SparkSession, sf: str) -> DataFrame:
    return SC.calls_of(_timed_scopes(spark, sf), sub.calls(spark, sf), _buckets(spark, sf))


@query
def calls_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    """What each frame and timing bucket calls: by range, or by the buckets that its time overlaps."""
    return SC.call_evidence(_calls_of(spark, sf))


oracle(
    "calls_in_scope",
    """, cn AS (SELECT id, name, count(*) AS n FROM cof GROUP BY ALL), ck AS (SELECT id, kind, count(*) AS n FROM cof GROUP BY ALL)
       SELECT id, CAST(any_value(c.calls) AS BIGINT) AS calls, any_value(c.names) AS distinct_names, any_value(c.h) AS histogram, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds FROM ck
       JOIN (SELECT id, sum(n) AS calls, count(*) AS names, string_agg(name || ':' || n, ',' ORDER BY n DESC, name) AS h FROM cn GROUP BY id) c USING (id) GROUP BY id""",
    *SCOPE_TABLE, "of",
)


@query
def states_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    """The first four action states of each frame."""
    c = sub.calls(spark, sf)
    states = action_states(c.withColumnRenamed("k", "handle")).join(SC.stream_offsets(c), STREAM).withColumn("global_index", F.col("base") + F.col("call_index"))
    frames = SC.frame_scopes(sub.frames(spark, sf))
    of = SC.calls_of(frames, c, _buckets(spark, sf))
    return SC.states_of(of, states, 4).select("id", "place", "global_index", "name", "kind", "pipeline")


oracle(
    "states_in_scope",
    f""", st AS (SELECT *, last_value(CASE WHEN name = 'vkCmdBindPipeline' THEN k END IGNORE NULLS) OVER (PARTITION BY {KEYS} ORDER BY call_index ROWS UNBOUNDED PRECEDING) AS pipeline FROM calls)
       SELECT cof.id, row_number() OVER (PARTITION BY cof.id ORDER BY global_index) - 1 AS place, global_index, st.name, st.kind, pipeline
       FROM cof JOIN st USING (global_index) WHERE cof.id LIKE 'frame:%' AND st.kind IN ('draw', 'dispatch', 'copy', 'clear', 'present') QUALIFY place < 4""",
    *SCOPE_TABLE, "of",
)


@query
def child_groups(spark: SparkSession, sf: str) -> DataFrame:
    return SC.child_groups(debug_groups(spark, sf))


oracle(
    "child_groups",
    f""", p AS (SELECT c.*, max(g.sequence) AS parent FROM groups c JOIN groups g ON c.device_index = g.device_index AND c.queue_index = g.queue_index AND c.stream_index = g.stream_index AND g.lvl = c.lvl - 1 AND g.call_start < c.call_start GROUP BY ALL)
        SELECT 'debug:' || device_index || ':' || queue_index || ':' || stream_index || ':' || parent AS id, count(*) AS children, min(sequence) AS first_child FROM p GROUP BY {KEYS}, parent""",
    *STREAMS, "groups",
)


@query
def region_report(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with their time, calls and the share of their time that metrics cover."""
    frames = SC.frame_scopes(sub.frames(spark, sf))
    stats = T.overlap_statistics(sub.frames(spark, sf), sub.samples(spark, sf), sub.metric_samples(spark, sf), width=sub.DAY_NS // 4)
    out = SC.region_report(frames, SC.call_evidence(SC.calls_of(frames, sub.calls(spark, sf), _buckets(spark, sf))), stats)
    return out.withColumns({c: F.round(c, 6) for c in ("least_metric_pct", "most_metric_pct")}).drop("kinds")


oracle(
    "region_report",
    """, ce AS (SELECT id, count(*) AS calls, count(DISTINCT name) AS names FROM cof GROUP BY id), cv AS (SELECT id, min(coverage_pct) AS lo, max(coverage_pct) AS hi FROM stats GROUP BY id)
       SELECT id, label, start_ns, end_ns, end_ns - start_ns AS duration_ns, precision, calls, names AS distinct_names, round(lo, 6) AS least_metric_pct, round(hi, 6) AS most_metric_pct
       FROM scopes LEFT JOIN ce USING (id) LEFT JOIN cv USING (id) WHERE kind = 'frame'""",
    *SCOPED, "calls", "buckets", "gb", "groups", "scopes", "of",
)


# filtered reads


@query
def timings_query(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets with a call that is a draw and matches, longest first."""
    found = SE.timings_of_one_call(timing_buckets(spark, sf), sub.calls(spark, sf), "draw", "Draw$")
    return SE.paged(found, [F.col("max_duration_ns").desc_nulls_last(), *STREAM, "bucket_index"], 3, 60).select(*STREAM, "bucket_index", "max_duration_ns")


_HAS = "EXISTS (SELECT 1 FROM calls c WHERE c.device_index = b.device_index AND c.queue_index = b.queue_index AND c.stream_index = b.stream_index AND c.call_index >= b.first_call AND c.call_index < b.next_call AND {})"
oracle("timings_query", f"SELECT {KEYS}, bucket_index, max_duration_ns FROM buckets b WHERE {_HAS.format('kind = ' + chr(39) + 'draw' + chr(39))} ORDER BY max_duration_ns DESC NULLS LAST, {KEYS}, bucket_index LIMIT 60 OFFSET 3", *STREAMS, "buckets")


@query
def timings_of_any_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets with a draw and with a call that matches, which may be another."""
    return SE.timings_of_any_calls(timing_buckets(spark, sf), sub.calls(spark, sf), "draw", "Copy|Clear").select(*STREAM, "bucket_index")


oracle("timings_of_any_calls", f"SELECT {KEYS}, bucket_index FROM buckets b WHERE {_HAS.format('kind = ' + chr(39) + 'draw' + chr(39))} AND {_HAS.format('kind IN (' + chr(39) + 'copy' + chr(39) + ', ' + chr(39) + 'clear' + chr(39) + ')')}", *STREAMS, "buckets")


@query
def actions_query(spark: SparkSession, sf: str) -> DataFrame:
    states = action_states(sub.calls(spark, sf).withColumnRenamed("k", "handle"))
    return SE.actions_query(states, "dispatch", "^vkCmd").select(*STREAM, "call_index", "name", "pipeline")


oracle(
    "actions_query",
    f""", st AS (SELECT *, last_value(CASE WHEN name = 'vkCmdBindPipeline' THEN k END IGNORE NULLS) OVER (PARTITION BY {KEYS} ORDER BY call_index ROWS UNBOUNDED PRECEDING) AS pipeline FROM calls)
        SELECT {KEYS}, call_index, name, pipeline FROM st WHERE kind = 'dispatch'""",
    *STREAMS,
)


def _artifacts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("text."), F.coalesce("lang", F.lit("none"))).alias("message_type"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


@query
def artifacts_query(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts by path or type."""
    return SE.artifacts_query(_artifacts(spark, sf), r"text\.de|/1\d$").select("path", "message_type", F.length("content").cast("bigint").alias("size"))


oracle(
    "artifacts_query",
    """WITH a AS (SELECT 'documents/' || doc_id AS path, 'text.' || coalesce(lang, 'none') AS message_type, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents)
       SELECT * FROM a WHERE regexp_matches(path, 'text\\.de|/1\\d$') OR regexp_matches(message_type, 'text\\.de|/1\\d$')""",
)


@query
def artifact_read(spark: SparkSession, sf: str) -> DataFrame:
    return SE.read_artifact(_artifacts(spark, sf), "documents/7", 16, 40)


oracle(
    "artifact_read",
    """SELECT 'documents/7' AS path, lower(substr(hex(encode(coalesce(text, ''))), 2 * least(16, n) + 1, 2 * (least(56, n) - least(16, n)))) AS data, least(16, n) AS start, least(56, n) AS stop, n AS total
       FROM (SELECT *, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents WHERE doc_id = 7)""",
)


@query
def counter_samples(spark: SparkSession, sf: str) -> DataFrame:
    s = sub.samples(spark, sf).select("range_index", "start_ns", "end_ns", "timestamp_valid", "complete", "duration_ns")
    return SE.paged(s, ["range_index"], 30, 100)


oracle("counter_samples", "SELECT range_index, start_ns, end_ns, timestamp_valid, complete, duration_ns FROM samples ORDER BY range_index LIMIT 100 OFFSET 30", *SCANNED[:3])


# choices


@query
def region_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The longest scopes of the first family that the capture has."""
    scopes = scope_table(spark, sf)
    kind = SE.region_kind(scopes.groupBy("kind").agg(F.count("*").alias("scopes")))
    return SE.select_regions(scopes, kind, None, 8).select("id", "duration_ns", "precision")


oracle("region_selection", "SELECT id, CASE WHEN end_ns >= start_ns THEN end_ns - start_ns END AS duration_ns, precision FROM scopes WHERE kind = 'debug_group' ORDER BY duration_ns DESC NULLS LAST, id LIMIT 128", *SCOPE_TABLE)


@query
def metric_selection(spark: SparkSession, sf: str) -> DataFrame:
    scan = metric_scan(spark, sf)
    return SE.select_metrics(scan, D.findings(scan), ["asked.for"], ["HIT_rate", "nothing"], 4)


oracle(
    "metric_selection",
    """, pick AS (SELECT 'asked.for' AS metric, 0 AS step, CAST(0 AS DOUBLE) AS rank
         UNION ALL SELECT metric, 1, -mean FROM (SELECT metric, coalesce(time_weighted_mean, sample_mean) AS mean, p95, sample_coverage_pct AS c FROM described WHERE mkind = 'throughput' AND valid_samples > 0) WHERE c >= 50 AND (mean >= 60 OR p95 >= 60)
         UNION ALL SELECT metric, 2, CAST(0 AS DOUBLE) FROM described WHERE valid_samples > 0
         UNION ALL SELECT metric, 3, -sample_mean FROM described WHERE valid_samples > 0 AND metric ILIKE '%hit_rate%')
       SELECT metric, row_number() OVER (ORDER BY step, rank, metric) - 1 AS place FROM (SELECT DISTINCT ON (metric) metric, step, rank FROM pick ORDER BY metric, step, rank)""",
    *SCANNED, "described",
)


@query
def scan_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return SE.scan_by_kind(metric_scan(spark, sf))


oracle("scan_by_kind", "SELECT mkind AS kind, count(*) AS scanned, count(CASE WHEN valid_samples > 0 THEN 1 END) AS available FROM described GROUP BY mkind", *SCANNED, "described")


# comparison


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Statistics of the frames before and from the split."""
    s = scope_overlap_stats(spark, sf).join(sub.frames(spark, sf).select("id", "start_ns"), "id")
    split = F.lit(1705363200_000_000_000)
    return s.where(F.col("start_ns") < split), s.where(F.col("start_ns") >= split)


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of the two halves in their order."""
    split = F.lit(1705363200_000_000_000)
    day = F.floor((F.col("start_ns") - split) / F.lit(sub.DAY_NS))
    f = sub.frames(spark, sf).withColumn("day", day)
    a = f.where("day < 0").select(F.col("id").alias("id_a"), (F.col("day") + 15).alias("day"))
    both = a.join(f.where("day >= 0").select(F.col("id").alias("id_b"), "day"), "day")
    return both.select("id_a", "id_b", F.col("day").cast("double").alias("duration_pct"))


@query
def scope_metric_deltas(spark: SparkSession, sf: str) -> DataFrame:
    out = C.scope_metric_deltas(_matched(spark, sf), *_halves(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_a", "mean_b", "delta", "relative_pct", "coverage_a", "coverage_b")})


PARTS["matched"] = """fd AS (SELECT *, (start_ns - 1705363200000000000) // 86400000000000 AS day FROM frames),
        matched AS (SELECT a.id AS id_a, b.id AS id_b, CAST(b.day AS DOUBLE) AS duration_pct FROM fd a JOIN fd b ON a.start_ns < 1705363200000000000 AND b.start_ns >= 1705363200000000000 AND a.day + 15 = b.day),
        sd AS (SELECT m.*, mm.metric, round(a.mean, 6) AS mean_a, round(b.mean, 6) AS mean_b, round(b.mean - a.mean, 6) AS delta,
               round((b.mean - a.mean) / nullif(a.mean, 0) * CAST(100 AS DOUBLE), 6) AS relative_pct, round(coalesce(a.coverage_pct, 0), 6) AS coverage_a, round(coalesce(b.coverage_pct, 0), 6) AS coverage_b
               FROM matched m CROSS JOIN (SELECT DISTINCT metric FROM ms) mm LEFT JOIN stats a ON a.id = m.id_a AND a.metric = mm.metric LEFT JOIN stats b ON b.id = m.id_b AND b.metric = mm.metric)"""
oracle("scope_metric_deltas", "SELECT * FROM sd", *SCOPED, "matched")


@query
def scope_delta_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return C.ranked_scopes(scope_metric_deltas(spark, sf), 8).withColumn("score", F.round("score", 6))


oracle(
    "scope_delta_ranking",
    "SELECT id_a, id_b, round(greatest(coalesce(abs(any_value(duration_pct)), 0), coalesce(max(abs(relative_pct)), 0)), 6) AS score FROM sd GROUP BY id_a, id_b ORDER BY score DESC, id_a LIMIT 8",
    *SCOPED, "matched",
)


@query
def compared_metrics(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (T.metric_scan(x) for x in _sides(spark, sf))
    deltas = C.ranked_deltas(C.metric_deltas(a, b)).where("metric like 'lts%'")
    return SE.compared_metrics(deltas.select("metric"), a)


oracle("compared_metrics", "SELECT metric FROM described", *SCANNED, "described")


@query
def item_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of two sources as shaders of two captures: changed ones first."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").where("lang is not null")
    items = C.match_items(d.where("source = 'src0'"), d.where("source = 'src1'"), ["lang"], "doc_id", "n_chars")
    return C.ordered_changes(items, 400).groupBy("lang", "change").agg(F.count("*").alias("items"))


oracle(
    "item_changes",
    """WITH x AS (SELECT lang, n_chars, source, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS o FROM documents WHERE source IN ('src0', 'src1') AND lang IS NOT NULL),
       a AS (SELECT * FROM x WHERE source = 'src0'), b AS (SELECT * FROM x WHERE source = 'src1'),
       m AS (SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.o, b.o) AS o, CASE WHEN a.o IS NULL THEN 'added' WHEN b.o IS NULL THEN 'removed' WHEN a.n_chars = b.n_chars THEN 'unchanged' ELSE 'changed' END AS change
             FROM a FULL OUTER JOIN b ON a.lang = b.lang AND a.o = b.o),
       f AS (SELECT * FROM m ORDER BY CASE change WHEN 'changed' THEN 0 WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END, lang, o LIMIT 400)
       SELECT lang, change, count(*) AS items FROM f GROUP BY lang, change""",
)


@query
def capture_reference(spark: SparkSession, sf: str) -> DataFrame:
    return C.capture_reference(QUERIES["quality_checks"](spark, sf))


oracle("capture_reference", f"SELECT arg_max(status, rank) AS quality, string_agg(CASE WHEN status <> 'pass' THEN code || ': ' || status END, ', ' ORDER BY rank DESC, code || ': ' || status) AS checks FROM ({ORACLES['quality_checks']})")


oracle(
    "scope_match",
    """, m AS (SELECT stream_index AS side, name AS label, queue_index || ':' || sequence AS id, call_stop - call_start AS d FROM groups QUALIFY row_number() OVER (PARTITION BY stream_index ORDER BY d DESC NULLS LAST, id) <= 32),
       o AS (SELECT *, row_number() OVER (PARTITION BY side, label ORDER BY d DESC NULLS LAST, id) - 1 AS occurrence FROM m)
       SELECT label, occurrence, a.id AS id_a, a.d AS duration_a, b.id AS id_b, b.d AS duration_b, b.d - a.d AS duration_delta, CASE WHEN a.d <> 0 THEN CAST(b.d - a.d AS DOUBLE) / a.d * 100 END AS duration_pct
       FROM (SELECT * FROM o WHERE side = 0) a JOIN (SELECT * FROM o WHERE side = 1) b USING (label, occurrence)""",
    "ev", "calls", "groups",
)


# shaders


def _shaders(spark: SparkSession, sf: str, build: int) -> DataFrame:
    """Parts as the shaders of one of two builds: the second lacks some of the first's, has others instead, and compiled some differently."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").where(k % 5 != 3 + build)
    return p.select(
        (k % 2).alias("device_index"), F.floor(k / 2).alias("index"), F.col("p_name").alias("name"), F.when(k % 4 > 0, F.col("p_brand")).alias("entry_point"), F.col("p_type").alias("stage"),
        F.lit("program").alias("shader_type"), F.when(k % 3 > 0, F.concat("p_name", F.lit(".src"))).alias("source_file"), k.alias("position"), F.col("p_size").alias("registers_per_thread"),
        F.when(k % 7 > 0, F.sha2(F.concat_ws("/", "p_type", F.floor(k / 400).cast("string")), 256)).alias("binary_sha256"),
        F.when(k % 7 > 0, F.floor(F.col("p_retailprice") + build)).alias("binary_size"),
    )


PARTS["shaders"] = """sh AS (SELECT p_partkey AS k, p_partkey % 2 AS device_index, p_partkey // 2 AS index, p_name AS name, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS entry_point, p_type AS stage, p_size AS regs,
        CASE WHEN p_partkey % 3 > 0 THEN p_name || '.src' END AS source_file, CASE WHEN p_partkey % 7 > 0 THEN sha256(p_type || '/' || (p_partkey // 400)) END AS sha, p_retailprice AS price FROM part)"""


@query
def shader_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Shaders of the second device that a pattern finds in any of their texts, whatever its case."""
    return SH.shader_inventory(_shaders(spark, sf, 0), "^WIDGET|brand#1$|econ", 1).select("device_index", "index", "name", "entry_point", "stage", "source_file")


oracle(
    "shader_inventory",
    """SELECT device_index, index, name, entry_point, stage, source_file FROM sh WHERE k % 5 <> 3 AND device_index = 1
       AND (name ILIKE 'widget%' OR source_file ILIKE 'widget%' OR lower(entry_point) LIKE '%brand#1' OR lower(stage) LIKE '%econ%' OR lower(name) LIKE '%econ%' OR lower(source_file) LIKE '%econ%')""",
    "shaders",
)


@query
def shader_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return SH.shader_deltas(_shaders(spark, sf, 0), _shaders(spark, sf, 1))


oracle(
    "shader_deltas",
    """, so AS (SELECT *, 0 AS build FROM sh WHERE k % 5 <> 3 UNION ALL SELECT *, 1 FROM sh WHERE k % 5 <> 4),
       sn AS (SELECT build, name, coalesce(entry_point, '') AS entry_point, stage, source_file, sha, regs, CASE WHEN sha IS NOT NULL THEN CAST(floor(price + build) AS BIGINT) END AS size,
              row_number() OVER (PARTITION BY build, name, coalesce(entry_point, ''), stage ORDER BY k) - 1 AS occurrence FROM so)
       SELECT name, entry_point, stage, occurrence, a.sha AS binary_sha256_a, a.size AS binary_size_a, a.regs AS registers_per_thread_a, a.source_file AS source_file_a, b.sha AS binary_sha256_b, b.size AS binary_size_b,
       b.regs AS registers_per_thread_b, b.source_file AS source_file_b, b.regs - a.regs AS register_delta, b.size - a.size AS binary_size_delta,
       CASE WHEN a.build IS NULL THEN 'added' WHEN b.build IS NULL THEN 'removed' WHEN a.sha IS NOT DISTINCT FROM b.sha THEN 'unchanged' ELSE 'changed' END AS change
       FROM (SELECT * FROM sn WHERE build = 0) a FULL OUTER JOIN (SELECT * FROM sn WHERE build = 1) b USING (name, entry_point, stage, occurrence)""",
    "shaders",
)


# views


@query
def saved_view(spark: SparkSession, sf: str) -> DataFrame:
    """A saved result of nations, as a view of it: filtered, sorted with nulls last, cut and projected."""
    rows = [r.asDict() for r in table(spark, sf, "nation").select("n_name", "n_regionkey", F.when(F.col("n_nationkey") % 4 > 0, F.col("n_nationkey")).alias("size")).orderBy("n_nationkey").collect()]
    got = view.apply_view({"rows": rows}, "/rows", [{"path": "/n_regionkey", "op": "ge", "value": 1}, {"path": "/n_name", "op": "contains", "value": "A"}], "/size", True, 1, 12, ["/n_name", "/size"])
    return spark.createDataFrame([(k, r["/n_name"], r["/size"]) for k, r in enumerate(got["items"])], "place bigint, name string, size bigint")


oracle(
    "saved_view",
    """SELECT row_number() OVER (ORDER BY size DESC NULLS LAST, k) - 2 AS place, name, size FROM (SELECT n_name AS name, n_nationkey AS k, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey END AS size, n_regionkey AS r FROM nation)
       WHERE r >= 1 AND name LIKE '%A%' QUALIFY place >= 0 AND place < 12""",
)


# composite queries


def _capture(spark: SparkSession, sf: str) -> reports.Capture:
    return reports.Capture(sub.calls(spark, sf).withColumnRenamed("k", "handle"), sub.boundaries(spark, sf), sub.frames(spark, sf), sub.samples(spark, sf), sub.metric_samples(spark, sf))


@query
def metric_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Both a named metric and one that a pattern finds, in two frames."""
    got = reports.metric_evaluation(_capture(spark, sf), ["lts__hit_rate.ratio"], ["SM__through"], ["frame:19723", "frame:19730"])
    return got.select("id", "metric", "valid_samples", *[F.round(c, 6).alias(c) for c in ("coverage_pct", "mean", "p95")])


oracle("metric_evaluation", "SELECT id, metric, valid_samples, round(coverage_pct, 6) AS coverage_pct, round(mean, 6) AS mean, round(p95, 6) AS p95 FROM stats WHERE id IN ('frame:19723', 'frame:19730')", *SCOPED)


@query
def capture_query(spark: SparkSession, sf: str) -> DataFrame:
    """Two sub-queries of one request, as JSON rows with their position."""
    got = reports.query_capture(_capture(spark, sf), [{"type": "calls", "kind": "sync", "limit": 7}, {"type": "scope_counts"}])
    parts = [json_rows(part["data"].select(*names)).withColumns({"index": F.lit(part["index"]), "type": F.lit(part["type"])}) for part, names in zip(got, (("global_index", "name"), ("kind", "scopes")))]
    return parts[0].unionByName(parts[1])


oracle(
    "capture_query",
    """, c AS (SELECT global_index, name FROM calls WHERE kind = 'sync' ORDER BY global_index LIMIT 7),
       n AS (SELECT 'debug_group' AS kind, count(*) AS scopes FROM groups UNION ALL SELECT 'nvtx_range', 0 UNION ALL SELECT 'frame', count(*) FROM frames
             UNION ALL SELECT 'action', count(*) FROM calls WHERE kind <> 'marker' UNION ALL SELECT 'timing_bucket', count(*) FROM buckets)
       SELECT 0 AS index, 'calls' AS type, '{"global_index":' || global_index || ',"name":"' || name || '"}' AS json FROM c
       UNION ALL SELECT 1, 'scope_counts', '{"kind":"' || kind || '","scopes":' || scopes || '}' FROM n""",
    "ev", "calls", "buckets", "groups", "frames",
)


@query
def scope_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What one timing bucket calls, with its first action state."""
    got = reports.scope_evidence(_capture(spark, sf), "bucket:3", states=1)
    return got["evidence"].join(got["action_states"].select("id", "global_index"), "id", "left")


oracle(
    "scope_evidence",
    """, cn AS (SELECT id, name, count(*) AS n FROM cof WHERE id = 'bucket:3' GROUP BY ALL), ck AS (SELECT id, kind, count(*) AS n FROM cof WHERE id = 'bucket:3' GROUP BY ALL)
       SELECT id, (SELECT CAST(sum(n) AS BIGINT) FROM cn) AS calls, (SELECT count(*) FROM cn) AS distinct_names, (SELECT string_agg(name || ':' || n, ',' ORDER BY n DESC, name) FROM cn) AS histogram,
       string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds, (SELECT min(global_index) FROM cof WHERE id = 'bucket:3' AND kind IN ('draw', 'dispatch', 'copy', 'clear', 'present')) AS global_index FROM ck GROUP BY id""",
    *SCOPE_TABLE, "of",
)
