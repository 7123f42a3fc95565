"""The shaders of a capture as a table: an inventory, the choice of one, and the match of two captures' shaders.

A row has ``device_index``, ``index`` (within its device), ``name``, ``entry_point``, ``stage``,
``shader_type``, ``source_file``, ``binary_sha256``, ``binary_size``, ``registers_per_thread`` and
``position``, its place in the capture, a whole number. Patterns don't tell case and match anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .selection import matching

KEY = ["name", "entry_point", "stage"]
LISTED = ("name", "entry_point", "source_file", "stage", "shader_type")
CHOSEN_BY = ("name", "entry_point", "stage", "source_file")
NAMED = 3


class ShaderError(ValueError):
    """No shader, or more than one, is meant."""


def on_device(device: int | None) -> Column:
    return F.lit(True) if device is None else F.col("device_index") == device


def shader_inventory(shaders: DataFrame, pattern: str | None = None, device: int | None = None) -> DataFrame:
    """Shaders of a device, or of all, of whose texts one matches."""
    return shaders.where(on_device(device) & matching(pattern and f"(?i){pattern}", *LISTED))


def device_counts(shaders: DataFrame, modules: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs, modules and shaders of each device that has any."""
    parts = [df.select("device_index", F.lit(what).alias("what")) for df, what in ((blobs, "blob"), (modules, "module"), (shaders, "shader"))]
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.groupBy("device_index").agg(*[F.count_if(F.col("what") == what).alias(f"{what}_count") for what in ("blob", "module", "shader")])


def select_shader(shaders: DataFrame, selector: str, device: int | None = None) -> DataFrame:
    """The one shader that a whole number names by its index (the first in the capture if several devices have it), or a pattern by its texts.

    Anything but exactly one match of a pattern, and an index that isn't there, is a ``ShaderError``.
    """
    candidates = shaders.where(on_device(device))
    if selector.isascii() and selector.isdigit():
        found = candidates.where(F.col("index") == int(selector)).orderBy("position").limit(1)
        if found.isEmpty():
            raise ShaderError(f"there is no shader {selector}")
        return found
    found = candidates.where(matching(f"(?i){selector}", *CHOSEN_BY))
    some = found.select("device_index", "index", "name").orderBy("position").limit(NAMED + 1).collect()
    if not some:
        raise ShaderError(f"{selector!r} matches no shader")
    if len(some) > 1:
        named = ", ".join(f"{r['device_index']}:{r['index']} {r['name']}" for r in some[:NAMED])
        raise ShaderError(f"{selector!r} matches several shaders ({named}{', and more' if len(some) > NAMED else ''}); give an index")
    return found


def shader_deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Shaders of both captures by name, entry point, stage and occurrence: what changed, and by how much.

    Occurrences are counted in the order of the captures, in blocks, so that a name that
    most shaders share doesn't end in one task. A null entry point is that of an empty
    name. Binaries are the same when their digests are, two missing ones included;
    a difference is null unless both sides have the number.
    """

    def take(df: DataFrame, x: str) -> DataFrame:
        named = df.withColumns({c: F.coalesce(c, F.lit("")) for c in KEY})
        return numbered(named, KEY, "position", "occurrence").select(
            *KEY, "occurrence", F.lit(True).alias(f"in_{x}"),
            *[F.col(c).alias(f"{c}_{x}") for c in ("binary_sha256", "binary_size", "registers_per_thread", "source_file")],
        )

    both = take(baseline, "a").join(take(candidate, "b"), [*KEY, "occurrence"], "full_outer")
    same = F.col("binary_sha256_a").eqNullSafe(F.col("binary_sha256_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.withColumns({
        "change": change, "register_delta": F.col("registers_per_thread_b") - F.col("registers_per_thread_a"), "binary_size_delta": F.col("binary_size_b") - F.col("binary_size_a"),
    }).drop("in_a", "in_b")


def leading_deltas(deltas: DataFrame, top: int = 50) -> DataFrame:
    """Changed shaders first, then added, removed and unchanged ones; within each by key."""
    order = F.element_at(F.create_map(*[F.lit(v) for pair in (("changed", 0), ("added", 1), ("removed", 2), ("unchanged", 3)) for v in pair]), F.col("change"))
    return deltas.withColumn("rank", order).orderBy("rank", *KEY, "occurrence").limit(top)
