"""What calls say in their arguments: labels, workload, barriers and handles.

Arguments are JSON of any depth, which no SQL expression can walk; one Arrow-batched
function reads each call's arguments once and returns everything that is wanted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: argument names
LABELS = frozenset(("message", "label", "name", "pmarkername", "plabelname"))
WORKLOAD = frozenset(
    "indexCount vertexCount instanceCount groupCountX groupCountY groupCountZ width height depth layerCount sampleCount count first mode"
    " indices numIndices baseVertex baseInstance".split()
)
BARRIER = {"srcStageMask": "src_stage", "dstStageMask": "dst_stage", "srcAccessMask": "src_access", "dstAccessMask": "dst_access"}
NUMBERS = ("uint32Value", "int32Value", "uint64Value", "int64Value")
TEXTS = ("uint64Value", "uint32Value", "int32Value", "int64Value")
NO_HANDLE = frozenset(("", "0", "VK_NULL_HANDLE", "0x0000000000000000"))
MOST_HANDLES = 64

COLUMNS = {
    "label": "string", "workload": "map<string, bigint>", "src_stage": "string", "dst_stage": "string", "src_access": "string", "dst_access": "string",
    "barrier_objects": "int", "handles": "array<string>",
}


def objects(value) -> Iterator[dict]:
    """All objects in a JSON value, outer before inner, in order."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            yield v
            todo.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            todo.extend(reversed(v))


def _inner(o: dict, field: str):
    v = o.get(field)
    return v.get("value") if isinstance(v, dict) else None


def _number(o: dict) -> int | None:
    for field in NUMBERS:
        v = _inner(o, field)
        if isinstance(v, str) and v.isascii() and v.isdigit():
            v = int(v)
        if isinstance(v, int) and not isinstance(v, bool) and v >= 0:
            return v
    return None


def _text(o: dict) -> str | None:
    for field in TEXTS:
        v = o.get(field)
        if isinstance(v, dict):
            shown = v.get("displayString")
            if isinstance(shown, str) and shown:
                return shown
            if isinstance(v.get("value"), str) or isinstance(v.get("value"), int) and not isinstance(v.get("value"), bool) and v["value"] >= 0:
                return str(v["value"])
    return None


def evidence(arguments: str | None) -> dict:
    """Everything that the columns of ``COLUMNS`` say about one call's arguments; what isn't JSON says nothing."""
    out = {"label": None, "workload": {}, "src_stage": None, "dst_stage": None, "src_access": None, "dst_access": None, "barrier_objects": 0, "handles": []}
    try:
        value = json.loads(arguments) if arguments else None
    except ValueError:
        return out
    first, named = None, None
    for o in objects(value):
        name = o.get("name")
        if isinstance(name, str):
            text = _inner(o, "stringValue")
            if isinstance(text, str):
                first = text if first is None else first
                named = text if named is None and name.lower() in LABELS else named
            if name in WORKLOAD and (n := _number(o)) is not None:
                out["workload"].setdefault(name.lower(), n)
            if name in BARRIER:
                out["barrier_objects"] += name == "srcStageMask"
                if out[BARRIER[name]] is None:
                    out[BARRIER[name]] = _text(o)
        handle = o["handleValue"].get("handle") if isinstance(o.get("handleValue"), dict) else None
        if isinstance(handle, str) and handle not in NO_HANDLE and len(out["handles"]) < MOST_HANDLES:
            out["handles"].append(handle)
    out["label"] = first if named is None else named
    return out


def with_evidence(calls: DataFrame, arguments: str = "arguments") -> DataFrame:
    """``calls`` with the columns of ``COLUMNS``; ``arguments`` is JSON text."""

    @F.pandas_udf(f"struct<{', '.join(f'{c}: {kind}' for c, kind in COLUMNS.items())}>")
    def read(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([evidence(v) for v in values], columns=list(COLUMNS))

    return calls.withColumn("__e", read(F.col(arguments))).select(*calls.columns, "__e.*")
