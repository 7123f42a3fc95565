from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tracequarry.operators.numbering import numbered
from tracequarry.plans.reports import Capture, QueryError, analyze, compare_captures, metric_evaluation, query_capture
from tracequarry.sources import sinks
from tracequarry.sources import substrate as sub
from tracequarry.streaming.windows import windowed_scan


def test_reports_say_what_is_missing(spark):
    frames, samples, metrics = sub.frames(spark, SMALL), sub.samples(spark, SMALL), sub.metric_samples(spark, SMALL)
    got = analyze(Capture(frames=frames, samples=samples, metric_samples=metrics), top=3, width=sub.DAY_NS // 4)
    assert got.sections["regions"].count() == 3 and got.sections["timing"] is None
    assert {m.split(":")[0] for m in got.unavailable} == {"timing_buckets", "timing", "quality", "workload"}
    none = analyze(Capture())
    assert all(v is None for v in none.sections.values()) and len(none.unavailable) == len(none.sections)
    both = compare_captures(Capture(metric_samples=metrics, frames=frames), Capture(metric_samples=metrics, frames=frames))
    assert {r["delta"] for r in both.sections["ranked_deltas"].collect()} == {0.0}


def test_windows_over_a_stream(spark, tmp_path):
    values = sub.metric_samples(spark, SMALL).selectExpr("timestamp_micros(start_ns div 1000) as ts", "metric", "value")
    values.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_scan(spark.readStream.schema(values.schema).parquet(str(tmp_path / "in")), "1 day", "1 day")
    query = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["start"], r["metric"]): r["valid_samples"] for r in spark.table("windowed").collect()}
    want = {(r["start"], r["metric"]): r["valid_samples"] for r in windowed_scan(values, "1 day", "1 day").collect()}
    assert got == want and got


def test_requests_that_are_refused(spark):
    capture = Capture(sub.calls(spark, SMALL), sub.boundaries(spark, SMALL), sub.frames(spark, SMALL))
    for bad in ([], [{"type": "calls"}] * 17, [{"type": "dance"}], [{"type": "scopes"}]):
        with pytest.raises(QueryError):
            query_capture(capture, bad)
    with pytest.raises(QueryError):
        query_capture(Capture(), [{"type": "scopes", "kind": "action"}])
    with pytest.raises(QueryError):
        metric_evaluation(capture)


def test_sub_queries(spark):
    base = Capture(sub.calls(spark, SMALL), sub.boundaries(spark, SMALL), sub.frames(spark, SMALL), sub.samples(spark, SMALL), sub.metric_samples(spark, SMALL))
    artifacts = spark.createDataFrame([("a.bin", "Blob", bytearray(b"abcdef")), ("b.txt", "Text", bytearray(b"x"))], "path string, message_type string, content binary")
    programs = spark.createDataFrame([(0, 0, "blur", "main", "cs", "x", None, 0), (1, 0, "sky", None, "ps", "x", None, 1)], "device_index int, index int, name string, entry_point string, stage string, shader_type string, source_file string, position bigint")
    whole = replace(base, artifacts=artifacts, shaders=programs)
    asked = [
        {"type": "capture_quality"}, {"type": "timeline_gaps", "max_gaps": 2}, {"type": "metric_discovery", "kind": "ratio", "pattern": "HIT"}, {"type": "frame_series", "metrics": [sub.HIT_RATE], "limit": 3},
        {"type": "artifact_inventory", "pattern": "blob|BLOB|Blob"}, {"type": "shader_inventory", "device": 1}, {"type": "scope_evidence", "scope": "bucket:1"}, {"type": "action_state", "limit": 2},
    ]
    got = {r["type"]: r["data"].collect() for r in query_capture(whole, asked)}
    assert {r["code"] for r in got["capture_quality"]} >= {"counter_image", "counter_timing_window", "action_attribution"}
    assert [r["metric"] for r in got["metric_discovery"]] == [sub.HIT_RATE] and len(got["frame_series"]) == 3 and got["frame_series"][0]["gap_ns"] is None
    assert [r["path"] for r in got["artifact_inventory"]] == ["a.bin"] and [r["name"] for r in got["shader_inventory"]] == ["sky"]
    assert len(got["scope_evidence"]) == 1 and len(got["action_state"]) == 2 and len(got["timeline_gaps"]) <= 8
    for q in ({"type": "artifact_read"}, {"type": "shader_inventory"}, {"type": "scope_ranking", "kind": "frame"}):
        with pytest.raises(QueryError):
            query_capture(base, [q])


def test_numbers_over_blocks(spark):
    rows = spark.createDataFrame([(k % 3, 7 * k) for k in range(200)], "key int, at bigint").repartition(4)
    got = sorted(tuple(r) for r in numbered(rows, ["key"], "at", "n", block=50).collect())
    assert got == sorted((k % 3, 7 * k, k // 3) for k in range(200))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [json.loads(r["json"]) for r in sinks.json_rows(df).collect()] == [{"a": 1, "b": None}, {"a": 2, "b": "x"}]
    folder = f"file://{tmp_path}/out"
    assert sinks.unpack({"t": df, "none": None}, folder) == ["t"] and spark.read.parquet(f"{folder}/t").count() == 2
    with pytest.raises(sinks.SinkError):
        sinks.unpack({"t": df}, folder)
    artifacts = df.select(F.concat(F.lit("p/"), F.col("a").cast("string")).alias("path"), F.encode(F.lit("abc"), "UTF-8").alias("content"))
    assert sinks.extract(artifacts, "p/1", f"{tmp_path}/f") == 3
    with pytest.raises(FileExistsError):
        sinks.extract(artifacts, "p/1", f"{tmp_path}/f")
    with pytest.raises(sinks.SinkError):
        sinks.extract(artifacts, "p/9", f"{tmp_path}/g")
