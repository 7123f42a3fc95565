"""Statistics of disassembled shaders: instruction mix, functions and source lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: how the opcodes of each kind start
MIX = {
    "loads": ("LD",), "constant_loads": ("LDC",), "spills_load": ("LDL",), "stores": ("ST",), "spills_store": ("STL",), "atomics": ("ATOM", "RED"),
    "branches": ("BRA", "BRX", "JMP", "CALL", "RET", "EXIT", "BSSY", "BSYNC"), "barriers": ("BAR", "MEMBAR", "DEPBAR", "WARPSYNC"),
    "textures": ("TEX", "TLD", "TXQ", "SULD", "SURG"),
}


def opcode_counts(instructions: DataFrame, by: list[str]) -> DataFrame:
    return instructions.groupBy(*by, F.coalesce("opcode", F.lit("UNKNOWN")).alias("opcode")).agg(F.count("*").alias("instructions"))


def instruction_mix(instructions: DataFrame, by: list[str]) -> DataFrame:
    """Instructions of each kind for each shader, from rows (``by``, ``function``, ``opcode``, ``predicate``, ``control_flow``)."""
    text = F.upper(F.coalesce("opcode", F.lit("UNKNOWN")))

    def starts(parts: tuple[str, ...]):
        out = F.lit(False)
        for p in parts:
            out = out | text.startswith(p)
        return out

    return instructions.groupBy(*by).agg(
        F.count("*").alias("instructions"), F.count_distinct("function").alias("functions"), *[F.count_if(starts(p)).alias(k) for k, p in MIX.items()],
        F.count_if(F.col("predicate").isNotNull()).alias("predicated"), F.count_if(F.lower("control_flow") == "true").alias("control_flow"),
    )


def source_lines(listing: DataFrame, by: list[str], top: int = 64) -> DataFrame:
    """Instructions for each source line of listings (``by``, ``ord``, ``text``): a line that names a file and number holds for the instructions after it. The ``top`` lines by count, with the number of all."""
    file = F.trim(F.regexp_extract("text", r"//## File (.*), line ([^,]*)$", 1))
    number = F.trim(F.regexp_extract("text", r"//## File (.*), line ([^,]*)$", 2))
    marks = F.col("text").contains("//## File ")
    mark = F.when(marks & number.rlike("^[0-9]+$") & (F.regexp_replace(file, '^"+|"+$', "") != ""), F.struct(F.regexp_replace(file, '^"+|"+$', "").alias("file"), number.cast("bigint").alias("line")))
    order = Window.partitionBy(*by).orderBy("ord")
    offset = F.trim(F.regexp_extract("text", r"/\*(.*?)\*/", 1))
    rows = listing.withColumns({"at": F.last(mark, True).over(order), "hex": F.when(~marks & offset.rlike("^[0-9a-fA-F]{1,15}$"), offset)}).where("at is not null and hex is not null")
    value = F.conv("hex", 16, 10).cast("bigint")
    lines = rows.groupBy(*by, "at.file", "at.line").agg(F.count("*").alias("instructions"), F.min(value).alias("first_offset"), F.max(value).alias("last_offset"))
    whole = Window.partitionBy(*by)
    rank = F.row_number().over(whole.orderBy(F.desc("instructions"), "file", "line"))
    return lines.withColumns({"lines": F.count("*").over(whole), "rank": rank}).where(F.col("rank") <= top)
