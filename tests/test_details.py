from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import arguments, document, instructions, scopes


def test_arguments(spark):
    plain = [{"name": "severity", "type": "UInt32"}, {"name": "message", "stringValue": {"value": "shadow pass 4"}}]
    nested = [{"name": "pLabelInfo", "structureValue": {"arguments": [{"name": "pLabelName", "stringValue": {"value": "outline blur"}}]}}]
    draw = [{"name": "indexCount", "uint32Value": {"value": 36}}, {"name": "INDEXCOUNT", "uint32Value": {"value": 1}}, {"name": "width", "uint64Value": {"value": "640"}}, {"name": "indexCount", "uint32Value": {"value": 9}}]
    barrier = [{"x": [{"name": "srcStageMask", "uint32Value": {"value": 4, "displayString": "TOP"}}, {"name": "srcStageMask", "uint32Value": {"value": 8}}, {"name": "dstStageMask", "uint64Value": {"value": 16}}]}]
    handles = [{"handleValue": {"handle": "0x10"}}, {"handleValue": {"handle": "0"}}, {"a": [{"handleValue": {"handle": "0x20"}}]}] + [{"handleValue": {"handle": f"h{k}"}} for k in range(80)]
    rows = [(k, json.dumps(v) if v is not None else None) for k, v in enumerate((plain, nested, draw, barrier, handles, None))] + [(6, "no json")]
    got = arguments.with_evidence(spark.createDataFrame(rows, "k int, arguments string")).orderBy("k").collect()
    assert [r["label"] for r in got] == ["shadow pass 4", "outline blur", *[None] * 5]
    assert got[2]["workload"] == {"indexcount": 36, "width": 640}
    assert (got[3]["src_stage"], got[3]["dst_stage"], got[3]["src_access"], got[3]["barrier_objects"]) == ("TOP", "16", None, 2)
    assert got[4]["handles"][:3] == ["0x10", "0x20", "h0"] and len(got[4]["handles"]) == 64


def test_scope_texts(spark):
    assert scopes.parse_scope("calls:3..9") == scopes.ScopeSpec("calls", "calls:3..9", 3, 9)
    assert scopes.parse_scope("frame:presented:0:0:1").kind == "id"
    for bad in ("calls:3", "calls:..3", "calls:1..2..3", "time:a..b", "samples:4..4", "planet:1..2"):
        with pytest.raises(scopes.ScopeError):
            scopes.parse_scope(bad)
    s = spark.createDataFrame([(0, 5, 9, False), (1, 100, 110, True), (2, 110, 140, True)], "range_index bigint, start_ns bigint, end_ns bigint, timestamp_valid boolean")
    assert tuple(scopes.time_scope(scopes.parse_scope("relative-time:5..20"), s).first())[1:] == (105, 120)
    assert tuple(scopes.time_scope(scopes.parse_scope("capture"), s).first())[1:] == (100, 140)


def test_instructions(spark):
    ops = ["LDG", "LDC", "LDL", "STG", "STL", "ATOMS", "BRA", "BAR.SYNC", "TEX", None]
    rows = [(1, "main", op, "@P0" if k == 0 else None, "True" if op == "BRA" else None) for k, op in enumerate(ops)]
    mix = instructions.instruction_mix(spark.createDataFrame(rows, "shader int, function string, opcode string, predicate string, control_flow string"), ["shader"]).first()
    assert (mix["instructions"], mix["loads"], mix["constant_loads"], mix["spills_load"], mix["stores"], mix["spills_store"], mix["atomics"]) == (10, 3, 1, 1, 2, 1, 1)
    assert (mix["branches"], mix["barriers"], mix["textures"], mix["predicated"], mix["control_flow"], mix["functions"]) == (1, 1, 1, 1, 1, 1)
    text = ['/*0000*/ NOP;', '//## File "a.frag", line 7', "/*0010*/ LDG;", "/*0020*/ STG;", '//## File "a.frag", line 9', "plain", "/*0030*/ EXIT;", "//## File broken", "/*0040*/ NOP;"]
    lines = instructions.source_lines(spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "shader int, ord int, text string"), ["shader"]).orderBy("rank").collect()
    assert [(r["file"], r["line"], r["instructions"], r["first_offset"], r["last_offset"], r["lines"]) for r in lines] == [("a.frag", 7, 2, 16, 32, 2), ("a.frag", 9, 2, 48, 64, 2)]


def test_documents(spark):
    doc = {"a": {"list": [{"n": k} for k in range(5)], "raw": b"abc"}, "x": float("nan")}
    got = document.query(doc, "a.list", offset=1, limit=2)
    assert got == {"items": [{"n": 1}, {"n": 2}], "offset": 1, "returned": 2, "total": 5, "next_offset": 3}
    assert document.query(doc, depth=1)["a"] == {"truncated": True, "kind": "message"} and document.query(doc)["x"] == "NaN"
    assert [f["path"] for f in document.byte_fields(doc)] == ["a.raw"] and document.to_json(doc)["a"]["raw"] == "YWJj"
    with pytest.raises(document.PathError):
        document.query(doc, "a.nothing")
    df = spark.createDataFrame([('{"a": {"list": [1, 2]}, "b": "x"}',), ('{"a": 3}',)], "t string").select(F.parse_json("t").alias("v"))
    assert [r["x"] for r in df.select(document.at_path(F.col("v"), "a.list.1", "int").alias("x")).collect()] == [2, None]
    fields = {(r["key"], r["kind"]): r["items"] for r in document.fields_at(df, "v", "").collect()}
    assert fields[("b", "STRING")] == 1 and sum(n for (k, _), n in fields.items() if k == "a") == 2
