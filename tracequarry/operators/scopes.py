"""Scopes from their written form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("capture", "debug:", "frame:", "action:", "bucket:", "nvtx:")


class ScopeError(ValueError):
    """A scope that can't be read or doesn't exist."""


@dataclass(frozen=True)
class ScopeSpec:
    """``kind`` is id, calls, samples, time or relative-time; the bounds are those of a range."""

    kind: str
    text: str
    start: int | None = None
    stop: int | None = None


def parse_range(text: str) -> tuple[int, int]:
    start, dots, stop = text.partition("..")
    if not dots:
        raise ScopeError(f"range {text!r} must be written A..B")
    if not start or not stop or ".." in stop:
        raise ScopeError(f"range {text!r} must have exactly two bounds")
    for name, bound in (("start", start), ("end", stop)):
        if not (bound.isascii() and bound.isdigit()):
            raise ScopeError(f"invalid range {name} {bound!r}")
    return int(start), int(stop)


def parse_scope(text: str) -> ScopeSpec:
    if any(text == f if f == "capture" else text.startswith(f) for f in FAMILIES):
        return ScopeSpec("id", text)
    for kind in ("calls", "samples", "time", "relative-time"):
        if text.startswith(f"{kind}:"):
            start, stop = parse_range(text[len(kind) + 1 :])
            if start >= stop:
                raise ScopeError(f"range {text!r} is empty")
            return ScopeSpec(kind, text, start, stop)
    raise ScopeError(f"invalid scope {text!r}: capture, an id, calls:A..B, samples:A..B, time:A..B or relative-time:A..B")


def time_scope(spec: ScopeSpec, samples: DataFrame) -> DataFrame:
    """One row (``id``, ``start_ns``, ``end_ns``) for a scope over time or the whole capture. Relative times count from the first valid sample; the capture goes from the first valid sample to the last one."""
    valid = samples.where("timestamp_valid").agg(F.min_by("start_ns", "range_index").alias("origin"), F.max_by("end_ns", "range_index").alias("last"))
    if spec.kind == "id" and spec.text == "capture":
        return valid.select(F.lit("capture").alias("id"), F.col("origin").alias("start_ns"), F.col("last").alias("end_ns"))
    if spec.kind not in ("time", "relative-time"):
        raise ScopeError(f"{spec.text!r} is no scope over time")
    base = F.col("origin") if spec.kind == "relative-time" else F.lit(0).cast("bigint")
    return valid.select(F.lit(spec.text).alias("id"), (base + F.lit(spec.start)).alias("start_ns"), (base + F.lit(spec.stop)).alias("end_ns"))


def by_id(scopes: DataFrame, text: str) -> DataFrame:
    return scopes.where(F.col("id") == text)
