"""Scalar functions over trace data, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a call's name holds, by kind; the first that fits decides
CALL_KINDS = (
    ("draw", ("draw",)),
    ("dispatch", ("dispatch",)),
    ("copy", ("copy", "blit", "resolve")),
    ("clear", ("clear",)),
    ("sync", ("barrier", "wait", "fence", "semaphore")),
    ("marker", ("marker", "debuggroup", "label", "beginevent", "endevent")),
    ("present", ("present", "swapbuffers")),
)
#: Kinds whose calls reset the collected state.
STATE_ACTIONS = ("draw", "dispatch", "copy", "clear", "present")
# fixed values: what a marker's name holds when it opens or closes a range
OPENS = ("pushdebuggroup", "begindebug", "beginevent", "beginlabel", "debugmarkerbegin")
CLOSES = ("popdebuggroup", "enddebug", "endevent", "endlabel", "debugmarkerend")
# fixed values: metric categories by how a base name starts or what it holds, in order
CATEGORIES = (
    ("shader", ("sm__", "smsp__", "tpc__"), ()),
    ("memory_l1tex", ("l1tex__", "tex__"), ()),
    ("memory_l2", ("lts__", "ltc__", "syslts__"), ()),
    ("memory_vram", ("dram__", "fbpa__"), ()),
    ("interconnect", ("pcie__", "nvlink__", "sys__"), ()),
    ("ray_tracing", ("rtcore__",), ("ray",)),
    ("geometry_frontend", ("pd__", "vaf__", "vpc__", "pes__", "gcc__"), ()),
    ("raster_backend", ("raster__", "prop__", "zrop__", "crop__"), ()),
    ("copy_engines", ("ce__", "copy__"), ()),
    ("video_display", ("nvenc__", "nvdec__", "display__"), ()),
    ("activity_sync", ("gpu__", "gr__"), ("idle", "wait")),
)
# fixed values: what the base name of a telling counter holds
TELLING = ("throughput", "duration", "time_", "_time", "active", "idle", "stall", "occupancy", "warp", "sector", "bytes", "cycles")
STATUS_RANK = {"pass": 0, "warn": 1, "fail": 2, "unknown": 3}


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def _first(text: Column, table, default: str | None) -> Column:
    out = F.lit(default) if default is not None else F.lit(None).cast("string")
    for value, parts in reversed(list(table)):
        out = F.when(_holds(text, parts), F.lit(value)).otherwise(out)
    return out


def call_kind(name: Column) -> Column:
    """Kind of an API call by its name; the first kind that fits."""
    return _first(F.lower(name), CALL_KINDS, "other")


def is_index_action(kind: Column) -> Column:
    """Whether a call counts in action numbering: anything but a marker."""
    return kind != "marker"


def is_state_action(kind: Column) -> Column:
    """Whether a call ends a state segment."""
    return kind.isin(*STATE_ACTIONS)


def marker_direction(name: Column) -> Column:
    """1 if a call opens a range, -1 if it closes one, else null; opening is looked for first."""
    text = F.lower(name)
    return F.when(_holds(text, OPENS), 1).when(_holds(text, CLOSES), -1)


def is_barrier(name: Column) -> Column:
    text = F.lower(name)
    return text.contains("barrier") | (text == "glfence")


def is_binding(name: Column) -> Column:
    return _holds(F.lower(name), ("bind", "attach", "useprogram", "use_program", "setpipeline", "set_pipeline"))


def is_pipeline_bind(name: Column) -> Column:
    return _holds(F.lower(name), ("bindpipeline", "use_program", "useprogram", "bindprogram", "bind_program", "setpipeline"))


def is_shader_bind(name: Column) -> Column:
    return _holds(F.lower(name), ("bindshader", "attachshader", "shaderobjects"))


def is_descriptor_bind(name: Column) -> Column:
    return _holds(F.lower(name), ("descriptorset", "descriptor_set", "binddescriptor"))


def metric_name(base: Column, kind: Column) -> Column:
    """The one form of a metric that is measured for its base name."""
    return F.concat(
        base, F.when(kind == "counter", ".avg").when(kind == "ratio", ".ratio").otherwise(".avg.pct_of_peak_sustained_elapsed")
    )


def metric_kind(name: Column) -> Column:
    return F.when(name.contains("throughput"), "throughput").when(name.endswith(".ratio"), "ratio").otherwise("counter")


def unit_hint(name: Column, kind: Column) -> Column:
    text = F.lower(name)
    return (
        F.when(_holds(text, ("pct_of_peak", "percent")), "percent_of_peak")
        .when((kind == "ratio") | text.endswith(".ratio"), "ratio")
        .when(text.contains("bytes"), "bytes_or_native")
        .when(text.contains("cycles"), "cycles")
        .when(_holds(text, ("_ns", "duration", "_time")), "nanoseconds_or_native")
        .otherwise("native")
    )


def metric_category(base: Column) -> Column:
    text = F.lower(base)
    out = F.lit("other")
    for value, starts, parts in reversed(CATEGORIES):
        fits = _holds(text, parts)
        for s in starts:
            fits = fits | text.startswith(s)
        out = F.when(fits, F.lit(value)).otherwise(out)
    return out


def metric_priority(kind: Column, base: Column) -> Column:
    """Throughputs before ratios before counters with a telling name before other counters."""
    return F.when(kind == "throughput", 4).when(kind == "ratio", 3).when(_holds(F.lower(base), TELLING), 2).otherwise(1)


def relative_change(before: Column, after: Column) -> Column:
    """In percent; null if either is null or the first is 0."""
    return (after - before) / F.nullif(before, F.lit(0.0)) * F.lit(100.0)


def percent(part: Column, total: Column) -> Column:
    """0 if there is nothing in total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part * F.lit(100.0) / total)


def threshold_status(value: Column, good: float = 90.0, bad: float = 50.0) -> Column:
    return F.when(value.isNull(), "unknown").when(value >= good, "pass").when(value < bad, "fail").otherwise("warn")


def threshold_message(label: str, value: Column, good: float = 90.0, bad: float = 50.0) -> Column:
    """What ``threshold_status`` found, as text, with the value to one place."""
    shown = F.format_string(f"{label}: %.1f%%", value)
    limit = F.when(value < bad, f" is below the usable threshold of {bad:.0f}%.").when(value < good, f" is below the preferred {good:.0f}%.").otherwise(".")
    return F.when(value.isNull(), f"{label}: unknown.").otherwise(F.concat(shown, limit))


def status_rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, F.lit(rank)).otherwise(out)
    return out


def duration(start: Column, end: Column) -> Column:
    """Null where the end lies before the start."""
    return F.when(end >= start, end - start)


def saturating(a: Column, b: Column) -> Column:
    """a - b, 0 at least."""
    return F.greatest(a - b, F.lit(0).cast("bigint"))


def finite(value: Column) -> Column:
    """NaN and the infinities as null; negative zero as zero."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value + F.lit(0.0))


def preview(content: Column, size: int = 32) -> Column:
    return F.lower(F.hex(F.substring(content, 1, size)))


def content_extension(content: Column) -> Column:
    """File extension by the first bytes; ``txt`` if nine tenths are printable, else ``bin``."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.decode(content, "ISO-8859-1")
    size = F.greatest(F.length(content), F.lit(1))
    shown = F.length(F.regexp_replace(text, r"[^\x20-\x7e\t\r\n]", ""))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("7F454C46"), "elf")
        .when(head.startswith("03022307"), "spv")
        .when((F.length(content) > 0) & (shown * 10 >= size * 9), "txt")
        .otherwise("bin")
    )


def safe_filename(name: Column) -> Column:
    clean = F.substring(F.regexp_replace(name, r"[^A-Za-z0-9_-]", "_"), 1, 140)
    return F.when(clean == "", "field").otherwise(clean)


def looks_like_pointer(text: Column) -> Column:
    return text.rlike(r"^0x[0-9a-fA-F]+$")


def register_hint(text: Column) -> Column:
    """The number after ``SHI_REGISTERS=``, null without one."""
    return F.nullif(F.regexp_extract(text, "SHI_REGISTERS=([0-9]+)", 1), F.lit("")).cast("bigint")


def sm_name(version: Column) -> Column:
    """``SM86`` for 0x00080600; ``unknown`` for 0; the number in hex without a major part."""
    major = F.shiftright(version, 16).bitwiseAND(F.lit(255))
    minor = F.shiftright(version, 8).bitwiseAND(F.lit(255))
    named = F.concat(F.lit("SM"), major.cast("string"), minor.cast("string"))
    return F.when(version == 0, "unknown").when(major > 0, named).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(version))))


def compute_threads(threads: Column, x: Column, y: Column, z: Column) -> Column:
    return F.coalesce(threads, x * y * z)


def occupancy(generation: Column, registers: Column, threads: Column, shared_bytes: Column) -> Column:
    """Static occupancy of one multiprocessor: the fewest warps that registers, block size and shared memory allow, and which of them, in that order, is the limit. Null where none is known."""
    most_threads = F.when(generation >= 120, 1536).otherwise(2048)
    most = F.when(generation >= 120, 48).otherwise(64)
    div = lambda a, b: F.floor(a / b).cast("bigint")
    block_warps = lambda t: F.ceil(t / 32).cast("bigint")
    t = F.greatest(threads, F.lit(1))
    by_registers = F.when(registers.isNotNull(), F.least(div(F.lit(65536), F.greatest(registers, F.lit(1)) * 32), most))
    by_threads = F.when(threads.isNotNull(), F.least(div(most_threads, t) * block_warps(t), most))
    blocks = F.greatest(div(F.lit(228 * 1024), shared_bytes), F.lit(1))
    by_shared = F.when(shared_bytes > 0, F.least(blocks * block_warps(F.coalesce(threads, F.lit(32))), most))
    warps = F.least(by_registers, by_threads, by_shared)
    limit = F.when(by_registers == warps, "registers").when(by_threads == warps, "threads_per_block").otherwise("shared_memory")
    return F.when(
        warps.isNotNull(),
        F.struct(
            by_registers.alias("by_registers"), by_threads.alias("by_threads"), by_shared.alias("by_shared"),
            warps.alias("warps"), (F.lit(100.0) * warps / most).alias("occupancy_pct"), limit.alias("limiting_factor"),
        ),
    )
