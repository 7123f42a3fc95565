"""Registered queries over what calls, documents and disassembled shaders say in detail, and over whole captures, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .capture_queries import _capture, _nvtx
from .operators import arguments, document, instructions, scopes
from .plans import reports
from .queries import KEYS, MIN_GAP, ORACLES, PARTS, SCOPED, STREAMS, oracle, query
from .sources import substrate as sub
from .sources.substrate import table

OPCODES = ("LDG", "STG", "BRA", "TEX", "ATOM", "BAR", "LDC", "EXIT")


@query
def call_arguments(spark: SparkSession, sf: str) -> DataFrame:
    """What the arguments of each call say: its label, work, barrier and handle."""
    e = sub.events(spark, sf)
    text = F.concat(
        F.lit('[{"name":"pLabelName","stringValue":{"value":"'), "event_type", F.lit('"}},{"inner":[{"name":"indexCount","uint32Value":{"value":'), F.col("k").cast("string"),
        F.lit('}},{"handleValue":{"handle":"'), F.col("user_id").cast("string"), F.lit('"}}]}'),
        F.when(F.col("event_type") == "error", F.concat(F.lit(',{"name":"srcStageMask","uint32Value":{"value":'), F.col("user_id").cast("string"), F.lit("}}"))).otherwise(""), F.lit("]"),
    )
    got = arguments.with_evidence(e.select("event_id", text.alias("arguments")))
    return got.select("event_id", "label", F.try_element_at("workload", F.lit("indexcount")).alias("index_count"), "src_stage", "dst_stage", "barrier_objects", F.get("handles", 0).alias("handle"))


oracle(
    "call_arguments",
    """SELECT event_id, event_type AS label, CASE WHEN k >= 0 THEN k END AS index_count, CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR) END AS src_stage, CAST(NULL AS VARCHAR) AS dst_stage,
       CAST(event_type = 'error' AS INTEGER) AS barrier_objects, CASE WHEN user_id <> 0 THEN CAST(user_id AS VARCHAR) END AS handle FROM ev""",
    "ev",
)


def _instructions(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as the instructions of their supplier's shader."""
    opcode = F.get(F.array(*map(F.lit, OPCODES)), F.col("l_partkey").cast("int") % 9)
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("shader"), F.col("l_returnflag").alias("function"), opcode.alias("opcode"), F.when(F.col("l_linenumber") > 4, "@P0").alias("predicate"),
        F.when(F.col("l_linestatus") == "O", "True").alias("control_flow"),
    )


PARTS["ins"] = f"ins AS (SELECT l_suppkey AS shader, l_returnflag AS function, {list(OPCODES)}[1 + l_partkey % 9] AS op, l_linenumber > 4 AS p, l_linestatus = 'O' AS c FROM lineitem)"


@query
def instruction_mix(spark: SparkSession, sf: str) -> DataFrame:
    return instructions.instruction_mix(_instructions(spark, sf), ["shader"])


oracle(
    "instruction_mix",
    """SELECT shader, count(*) AS instructions, count(DISTINCT function) AS functions, count(CASE WHEN op IN ('LDG', 'LDC') THEN 1 END) AS loads, count(CASE WHEN op = 'LDC' THEN 1 END) AS constant_loads,
       CAST(0 AS BIGINT) AS spills_load, count(CASE WHEN op = 'STG' THEN 1 END) AS stores, CAST(0 AS BIGINT) AS spills_store, count(CASE WHEN op = 'ATOM' THEN 1 END) AS atomics,
       count(CASE WHEN op IN ('BRA', 'EXIT') THEN 1 END) AS branches, count(CASE WHEN op = 'BAR' THEN 1 END) AS barriers, count(CASE WHEN op = 'TEX' THEN 1 END) AS textures,
       count(CASE WHEN p THEN 1 END) AS predicated, count(CASE WHEN c THEN 1 END) AS control_flow FROM ins GROUP BY shader""",
    "ins",
)


@query
def opcode_counts(spark: SparkSession, sf: str) -> DataFrame:
    return instructions.opcode_counts(_instructions(spark, sf), ["shader"])


oracle("opcode_counts", "SELECT shader, coalesce(op, 'UNKNOWN') AS opcode, count(*) AS instructions FROM ins GROUP BY ALL", "ins")


@query
def source_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the listing of their user's shader: views name a source line, errors are plain text. Each shader's three lines with the most instructions."""
    k = F.col("k").cast("string")
    mark = F.concat(F.lit('//## File "u'), k, F.lit('.src", line '), (F.col("k") % 3 + 1).cast("string"))
    text = F.when(F.col("event_type") == "view", mark).when(F.col("event_type") == "error", "plain").otherwise(F.concat(F.lit("/*"), F.lower(F.hex("event_id")), F.lit("*/ NOP;")))
    return instructions.source_lines(sub.events(spark, sf).select(F.col("user_id").alias("shader"), F.col("event_id").alias("ord"), text.alias("text")), ["shader"], 3)


oracle(
    "source_lines",
    """, sl AS (SELECT user_id AS shader, event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN 'u' || k || '.src' END IGNORE NULLS) OVER w AS file,
             last_value(CASE WHEN event_type = 'view' THEN k % 3 + 1 END IGNORE NULLS) OVER w AS line FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
       sc AS (SELECT shader, file, line, count(*) AS instructions, min(event_id) AS first_offset, max(event_id) AS last_offset FROM sl WHERE event_type NOT IN ('view', 'error') AND file IS NOT NULL GROUP BY ALL)
       SELECT *, count(*) OVER (PARTITION BY shader) AS lines, CAST(row_number() OVER (PARTITION BY shader ORDER BY instructions DESC, file, line) AS INTEGER) AS rank FROM sc QUALIFY rank <= 3""",
    "ev",
)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Events as nested documents whose fields depend on their type."""
    more = F.when(F.col("event_type") == "purchase", ',"paid":true').when(F.col("event_type") == "signup", ',"name":"new"').otherwise("")
    text = F.concat(F.lit('{"user":{"id":'), F.col("user_id").cast("string"), more, F.lit('},"list":[{"n":1},{"n":'), F.col("k").cast("string"), F.lit("}]}"))
    return sub.events(spark, sf).select("event_id", F.parse_json(text).alias("document"))


@query
def document_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of the objects at one path of all documents."""
    return document.fields_at(_documents(spark, sf), "document", "user")


oracle(
    "document_fields",
    """, f AS (SELECT 'id' AS key, 'BIGINT' AS kind FROM ev UNION ALL SELECT 'paid', 'BOOLEAN' FROM ev WHERE event_type = 'purchase' UNION ALL SELECT 'name', 'STRING' FROM ev WHERE event_type = 'signup')
       SELECT key, kind, count(*) AS items FROM f GROUP BY ALL""",
    "ev",
)


@query
def document_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Values at paths through objects and lists; null where a document lacks the path."""
    at = lambda path, kind: document.at_path(F.col("document"), path, kind)
    return _documents(spark, sf).select("event_id", at("list.1.n", "bigint").alias("second"), at("user.name", "string").alias("name"), at("list.2.n", "bigint").alias("third"))


oracle("document_paths", "SELECT event_id, k AS second, CASE WHEN event_type = 'signup' THEN 'new' END AS name, CAST(NULL AS BIGINT) AS third FROM ev", "ev")


@query
def time_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes from their written form: the capture, a stretch of time, and one that counts from the first valid sample."""
    s = sub.samples(spark, sf)
    parts = [scopes.time_scope(scopes.parse_scope(text), s) for text in ("capture", "time:1704067200000000000..1704153600000000000", "relative-time:5000..70000")]
    return parts[0].union(parts[1]).union(parts[2])


oracle(
    "time_scopes",
    """, o AS (SELECT arg_min(start_ns, range_index) AS a, arg_max(end_ns, range_index) AS b FROM samples WHERE timestamp_valid)
       SELECT 'capture' AS id, a AS start_ns, b AS end_ns FROM o UNION ALL SELECT 'time:1704067200000000000..1704153600000000000', 1704067200000000000, 1704153600000000000
       UNION ALL SELECT 'relative-time:5000..70000', a + 5000, a + 70000 FROM o""",
    "ev", "s", "samples",
)


@query
def capture_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes by kind and the workload, of the overview of a capture."""
    got = reports.overview(replace(_capture(spark, sf), nvtx=_nvtx(spark, sf)))
    return got["calls"].select("section", "name", "value").union(got["scopes"].select(F.lit("scopes"), "kind", "scopes"))


oracle(
    "capture_overview",
    f"""SELECT section, name, value FROM ({ORACLES["workload_summary"]}) UNION ALL SELECT 'scopes', kind, scopes FROM ({ORACLES["scope_counts"]})""",
)


@query
def capture_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Each stream's timing buckets as a lane: busy time, gaps of an hour and more."""
    return reports.query_capture(_capture(spark, sf), [{"type": "timeline", "min_gap_ns": MIN_GAP}])[0]["data"]


oracle(
    "capture_timeline",
    f""", tf AS (SELECT *, CASE WHEN max(end_ns) OVER (PARTITION BY {KEYS} ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_ns THEN 0 ELSE 1 END AS nw FROM buckets WHERE end_ns > start_ns),
       ti AS (SELECT *, sum(nw) OVER (PARTITION BY {KEYS} ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING) AS isl FROM tf),
       tm AS (SELECT {KEYS}, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM ti GROUP BY {KEYS}, isl),
       tg AS (SELECT {KEYS}, start_ns - lag(end_ns) OVER (PARTITION BY {KEYS} ORDER BY start_ns) AS gap FROM tm)
       SELECT {KEYS}, min(start_ns) AS first_ns, max(end_ns) AS last_ns, CAST(sum(end_ns - start_ns) AS BIGINT) AS busy_ns, max(end_ns) - min(start_ns) - CAST(sum(end_ns - start_ns) AS BIGINT) AS gap_ns, count(*) AS unions,
       coalesce(any_value(n), 0) AS gaps, any_value(g) AS longest_gap_ns FROM tm LEFT JOIN (SELECT {KEYS}, count(*) AS n, max(gap) AS g FROM tg WHERE gap >= {MIN_GAP} GROUP BY {KEYS}) x USING ({KEYS}) GROUP BY {KEYS}""",
    *STREAMS, "buckets",
)


@query
def capture_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Frames by the mean of one metric, lowest first."""
    asked = {"type": "scope_ranking", "kind": "frame", "metric": sub.HIT_RATE, "descending": False, "top": 5}
    return reports.query_capture(_capture(spark, sf), [asked])[0]["data"].withColumn("value", F.round("value", 6))


oracle("capture_ranking", f"SELECT metric, id, round(mean, 6) AS value, row_number() OVER (ORDER BY mean, id) AS rank FROM stats WHERE mean IS NOT NULL AND metric = '{sub.HIT_RATE}' QUALIFY rank <= 5", *SCOPED)


@query
def capture_report(spark: SparkSession, sf: str) -> DataFrame:
    """Of the report of a capture whose info tables are missing: its checks, its pressure and how many sections it lacks."""
    got = reports.report(_capture(spark, sf))
    checks = got["quality"].select(F.lit("quality").alias("section"), F.col("code").alias("name"), F.col("status").alias("value"))
    load = got["categories"].select(F.lit("categories"), "category", F.col("available").cast("string"))
    return checks.union(load).union(spark.range(1).select(F.lit("unavailable"), F.lit("sections"), F.lit(str(len(got["unavailable"])))))


oracle(
    "capture_report",
    f"""SELECT 'quality' AS section, code AS name, status AS value FROM ({ORACLES["quality_checks"]}) WHERE code NOT IN ('environment_identity', 'gpu_clocks', 'vsync', 'time_every_action')
        UNION ALL SELECT 'categories', category, CAST(available AS VARCHAR) FROM ({ORACLES["category_summary"]}) UNION ALL SELECT 'unavailable', 'sections', '0'""",
)
