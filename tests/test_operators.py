"""The operators on small inputs whose results are known."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.functions import scalars as S
from tracequarry.operators import compare, diagnostics, intervals, shaders, state, statistics, streams
from tracequarry.operators import quality as Q


def samples(spark):
    rows = [(0, 0, 10, 10.0, None), (1, 10, 20, 30.0, None)]
    base = spark.createDataFrame(rows, "range_index bigint, start_ns bigint, end_ns bigint, m double, other double")
    s = base.select("range_index", "start_ns", "end_ns", F.lit(True).alias("timestamp_valid"))
    long = base.select("range_index", "start_ns", "end_ns", F.explode(F.create_map(F.lit("m"), "m", F.lit("null"), "other")).alias("metric", "value"))
    return s, long


def test_overlap_statistics(spark):
    s, m = samples(spark)
    scopes = spark.createDataFrame([("single", 5, 15), ("outer", 0, 20), ("nested", 0, 10), ("none", 50, 60)], "id string, start_ns bigint, end_ns bigint")
    got = {(r["id"], r["metric"]): r for r in statistics.overlap_statistics(scopes, s, m).collect()}
    assert (got["single", "m"]["mean"], got["single", "m"]["coverage_pct"], got["single", "m"]["p50"]) == (20.0, 100.0, 20.0)
    assert got["outer", "m"]["mean"] == 20.0 and got["nested", "m"]["mean"] == 10.0
    assert got["outer", "null"]["mean"] is None and got["outer", "null"]["coverage_pct"] == 0.0
    assert got["none", "m"]["mean"] is None and got["none", "m"]["selected_samples"] == 0


@pytest.mark.parametrize(("weights", "want"), [(((1.0, 1), (2.0, 1), (2.0, 9)), 2.0), (((1.0, 1), (2.0, 9), (2.0, 1)), 1.34)])
def test_percentile_ties(spark, weights, want):
    rows = spark.createDataFrame([("k", v, w, i) for i, (v, w) in enumerate(weights)], "k string, v double, w bigint, i bigint")
    got = statistics.weighted_percentiles(rows, ["k"], "v", "w", "i", {"p": 0.2}).first()["p"]
    assert got == pytest.approx(want)


def test_merge_touching_and_gaps(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 9), ("a", 10, 12), ("a", 11, 20), ("a", 22, 23)], "lane string, start_ns bigint, end_ns bigint")
    merged = intervals.merge_intervals(rows, ["lane"])
    assert sorted((r["start_ns"], r["end_ns"]) for r in merged.collect()) == [(0, 7), (10, 20), (22, 23)]
    lane = intervals.lane_timeline(rows, ["lane"], 3).first()
    assert (lane["busy_ns"], lane["gap_ns"], lane["gaps"], lane["longest_gap_ns"]) == (18, 5, 1, 3)
    assert sorted((r["start_ns"], r["end_ns"]) for r in intervals.merge_all(rows, slices=3).collect()) == [(0, 7), (10, 20), (22, 23)]


def calls(spark, names):
    rows = [(0, 0, 0, i, n, len(names), i) for i, n in enumerate(names)]
    c = spark.createDataFrame(rows, "device_index bigint, queue_index bigint, stream_index bigint, call_index bigint, name string, stream_calls bigint, handle bigint")
    return c.withColumn("kind", S.call_kind(F.col("name")))


def test_debug_groups_like_a_stack(spark):
    rng = np.random.default_rng(5)
    names = [["vkCmdEndDebugUtilsLabelEXT", "vkCmdBeginDebugUtilsLabelEXT", "vkCmdDraw"][k] for k in rng.integers(0, 3, 300)]
    stack, want, n = [], {}, 0
    for i, name in enumerate(names):
        if "Begin" in name:
            want[i] = [len(stack), want[stack[-1]][2] if stack else None, n, len(names), False]
            stack.append(i)
            n += 1
        elif "End" in name and stack:
            want[stack.pop()][3:] = [i, True]
    got = {r["call_start"]: [r["depth"], r["parent"], r["sequence"], r["call_stop"], r["closed"]] for r in streams.debug_groups(calls(spark, names)).collect()}
    assert got == want


def test_action_states_keep_the_last_eight_barriers(spark):
    names = ["vkCmdBindPipeline", *["vkCmdPipelineBarrier"] * 10, "vkCmdDraw", "vkCmdBindPipeline", "vkCmdDispatch"]
    draw, dispatch = sorted(state.action_states(calls(spark, names)).collect(), key=lambda r: r["action_index"])
    assert (draw["pipeline"], draw["bindings"], draw["barrier_count"], draw["recent_barriers"]) == (0, 1, 10, "[3,4,5,6,7,8,9,10]")
    assert (dispatch["pipeline"], dispatch["bindings"], dispatch["barrier_count"], dispatch["recent_barriers"]) == (12, 1, 0, "[]")


def test_buckets_with_missing_stages(spark):
    rows = [(0, 0, "BOTTOM_OF_PIPE", 10), (0, 0, "TOP_OF_PIPE", 5), (1, 4, "TOP_OF_PIPE", 20), (2, 6, "BOTTOM_OF_PIPE", 40), (2, 6, "TOP_OF_PIPE", 15)]
    b = spark.createDataFrame([(0, 0, 0, *r) for r in rows], "device_index bigint, queue_index bigint, stream_index bigint, timestamp_index bigint, next_call_index bigint, stage string, ptimer bigint")
    got = {r["bucket_index"]: r for r in streams.timing_buckets(b).collect()}
    assert (got[0]["start_ns"], got[0]["end_ns"], got[0]["call_count"]) == (5, 20, 4)
    assert got[1]["start_ns"] is None and got[1]["stage_count"] == 0


def test_draws_equal_a_scalar_loop():
    x, want = compare.SEED, []
    for _ in range(1000):
        x = (x * compare.FACTOR + compare.STEP) % 2**64
        want.append(x)
    assert compare.draws(1000).tolist() == want


def test_bootstrap_interval():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 63), rng.normal(3, 1, 70)
    low, high = compare.bootstrap_interval(a, np.ones(63), b, np.ones(70))
    assert low <= high and low < 3 < high + 1
    a, b = rng.normal(0, 1, 64), rng.normal(3, 1, 64)
    low, high = compare.bootstrap_interval(a, np.ones(64), b, np.ones(64))
    assert high - low < 1e-9  # the generator's low bits visit each index once
    assert compare.bootstrap_interval(a[:1], np.ones(1), b, np.ones(64)) is None


def test_high_throughput_is_a_finding(spark):
    row = ("sm__throughput.avg.pct_of_peak_sustained_elapsed", 4, 4, 4, 85.0, 85.0, 80.0, 90.0, 3.0, 0, 84.0, 90.0, 100.0, 1.06)
    kinds = "metric string, selected_samples bigint, valid_samples bigint, nonzero_samples bigint, sample_mean double, time_weighted_mean double, min double, max double, stddev double, peak_sample_index bigint, p50 double, p95 double, sample_coverage_pct double, burst_ratio double"
    got = diagnostics.findings(spark.createDataFrame([row], kinds)).collect()
    assert [(r["severity"], r["category"]) for r in got] == [("high", "shader")]


def test_scalars(spark):
    df = spark.createDataFrame([(0x00080600, "SHI_REGISTERS=107;"), (0x000C0000, "none"), (0, None)], "v bigint, t string")
    got = df.select(S.sm_name(F.col("v")).alias("sm"), S.register_hint(F.col("t")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("SM86", 107), ("SM120", None), ("unknown", None)]
    kinds = spark.createDataFrame([("glBlitFramebuffer",), ("vkQueuePresentKHR",), ("glFenceSync",), ("glFoo",)], "n string").select(S.call_kind(F.col("n")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["copy", "present", "sync", "other"]
    content = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n"),), (bytearray(b"plain text"),), (bytearray(range(256)),)], "c binary").select(S.content_extension(F.col("c")).alias("e"))
    assert [r["e"] for r in content.collect()] == ["png", "txt", "bin"]


def test_quality_without_counters_and_of_a_locked_session(spark):
    timing = spark.createDataFrame([(10, 5, 49.95)], "calls bigint, covered bigint, coverage_pct double")
    buckets = spark.createDataFrame([], "call_count bigint, start_ns bigint, end_ns bigint")
    frames = spark.createDataFrame([], "id string")
    rows = [("GPU", " Device Name", "X1\t", 0), ("GPU", "Driver Version", None, 1), (Q.SETTINGS, "GPU Clocks", "Unlocked", 2), (Q.SETTINGS, "GPU Clocks ", "Locked to Boost", 3)]
    rows += [(Q.SETTINGS, "V-Sync Mode", "Off", 4), (Q.SETTINGS, "Time Every Action", "NO", 5), (None, "Device Name", "other", 6)]
    told = Q.capture_environment(spark.createDataFrame(rows, "table string, name string, value string, ord int"))
    assert told.select("gpu", "driver", "chip").first() == ("X1", "", None)
    got = {r["code"]: (r["status"], r["message"]) for r in Q.quality_checks(None, timing, buckets, frames, None, told).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "counter_image": "warn", "call_timestamp_coverage": "fail", "timing_buckets": "fail", "frame_markers": "warn", "gpu_clocks": "warn", "time_every_action": "warn",
    }
    assert got["gpu_clocks"][1].endswith("Locked to Boost") and got["call_timestamp_coverage"][1].endswith("50%.")
    checks = Q.quality_checks(None, timing, buckets, frames)
    assert Q.overall_status(checks).first()[0] == "fail" and Q.overall_status(checks.limit(0)).first()[0] == "unknown"
    empty = Q.capture_environment(spark.createDataFrame([], "table string, name string, value string, ord int"))
    assert {r["code"] for r in Q.quality_checks(None, timing, buckets, frames, None, empty).collect()} - set(got) == {"environment_identity"}


def test_shaders(spark):
    cols = "device_index int, index int, name string, entry_point string, stage string, shader_type string, source_file string, binary_sha256 string, binary_size bigint, registers_per_thread int, position bigint"
    rows = [(0, 0, "Blur", "main", "cs", "x", "a.src", "1", 10, 8, 0), (0, 1, "Blur", "main", "cs", "x", None, "2", 20, 16, 1), (1, 0, "sky", None, "ps", "x", "b.src", None, None, None, 2)]
    one = spark.createDataFrame(rows, cols)
    two = spark.createDataFrame([(0, 0, "Blur", "main", "cs", "x", "a.src", "9", 14, 6, 0), (0, 1, "new", "main", "vs", "x", None, "3", 5, 4, 1), (1, 0, "sky", "", "ps", "x", "b.src", None, None, None, 2)], cols)
    got = [(r["rank"], r["name"], r["occurrence"], r["register_delta"], r["binary_size_delta"]) for r in shaders.leading_deltas(shaders.shader_deltas(one, two)).collect()]
    assert got == [(0, "Blur", 0, -2, 4), (1, "new", 0, None, None), (2, "Blur", 1, None, None), (3, "sky", 0, None, None)]
    assert {r["change"] for r in shaders.shader_deltas(one, two.limit(0)).collect()} == {"removed"}
    assert shaders.select_shader(one, "SKY").first()["device_index"] == 1 and shaders.select_shader(one, "0").first()["name"] == "Blur"
    assert shaders.select_shader(one, "0", device=1).first()["name"] == "sky" and shaders.shader_inventory(one, "MAIN").count() == 2
    for bad in ("blur", "nothing", "7"):
        with pytest.raises(shaders.ShaderError):
            shaders.select_shader(one, bad)
    counts = {r["device_index"]: (r["blob_count"], r["module_count"], r["shader_count"]) for r in shaders.device_counts(one, one.limit(0), one.where("device_index = 1")).collect()}
    assert counts == {0: (0, 0, 2), 1: (1, 0, 1)}
