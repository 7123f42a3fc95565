"""Nested documents: paths, schema and byte fields.

Documents are kept as VARIANT columns; a path reads one field without decoding the
rest. The recursive views below work on one decoded document, on the driver.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVIEW = 32


class PathError(ValueError):
    """A path that a document doesn't have."""


def variant_path(path: str) -> str:
    """A dotted path, numbers being list indexes, as a path of ``variant_get``."""
    out = "$"
    for step in filter(None, path.split(".")):
        out += f"[{step}]" if step.isdigit() else f"['{step.replace(chr(39), chr(92) + chr(39))}']"
    return out


def at_path(document: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(document, variant_path(path), kind)


def fields_at(documents: DataFrame, document: str, path: str) -> DataFrame:
    """(``key``, ``items``, ``kind``): the fields of the objects at ``path``, how many documents have them, and their kind."""
    inside = documents.select(at_path(F.col(document), path).alias("__v")).where("__v is not null")
    inside.createOrReplaceTempView("__fields_at")
    rows = inside.sparkSession.sql("SELECT e.key, schema_of_variant(e.value) AS kind FROM __fields_at, LATERAL variant_explode_outer(__v) AS e")
    return rows.where("key is not null").groupBy("key", "kind").agg(F.count("*").alias("items"))


def resolve(value, path: str):
    for step in filter(None, path.split(".")):
        if isinstance(value, dict) and step in value:
            value = value[step]
        elif isinstance(value, list) and step.isdigit() and int(step) < len(value):
            value = value[int(step)]
        else:
            raise PathError(f"nothing at {path!r}")
    return value


def render(value, depth: int, offset: int = 0, limit: int = 100, root: bool = True):
    """A value down to ``depth`` levels: what lies deeper is named by its kind, bytes by size, hash and preview. Lists are cut to pages, also nested ones; the offset holds for the outermost list."""
    if isinstance(value, (bytes, bytearray)):
        return {"size": len(value), "sha256": hashlib.sha256(value).hexdigest(), "preview_hex": bytes(value[:PREVIEW]).hex()}
    if not isinstance(value, (dict, list)):
        if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
            return "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"
        return value
    if depth <= 0:
        return {"truncated": True, "kind": "message" if isinstance(value, dict) else "list"}
    if isinstance(value, dict):
        return {k: render(v, depth - 1, 0, limit, False) for k, v in list(value.items())[: limit if not root else None]}
    start = min(offset if root else 0, len(value))
    part = value[start : start + limit]
    items = [render(v, depth - 1, 0, limit, False) for v in part]
    after = start + len(part)
    if not root and after == len(value):
        return items
    return {"items": items, "offset": start, "returned": len(part), "total": len(value), "next_offset": after if after < len(value) else None}


def query(document, path: str = "", depth: int = 4, offset: int = 0, limit: int = 100):
    return render(resolve(document, path), max(1, min(12, depth)), offset, max(1, min(100, limit)))


def byte_fields(value, path: str = "") -> Iterator[dict]:
    """Every non-empty bytes field: its path, size, hash and preview."""
    if isinstance(value, (bytes, bytearray)):
        if value:
            yield {"path": path} | render(value, 1)
    elif isinstance(value, (dict, list)):
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from byte_fields(v, f"{path}.{k}" if path else str(k))


def to_json(value):
    """A document as JSON values, bytes in base64."""
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    if isinstance(value, dict):
        return {str(k): to_json(v) for k, v in value.items()}
    return [to_json(v) for v in value] if isinstance(value, list) else render(value, 1)
