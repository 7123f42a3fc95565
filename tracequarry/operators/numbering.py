"""Row numbers without a window over everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def numbered(rows: DataFrame, keys: list[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: each row's place, from 0, among those of its ``keys`` by the whole number ``order``.

    Rows are numbered within blocks of ``order``, and blocks get offsets from their
    counts, so that one key's rows are spread over many tasks. Keys must not be null.
    """
    dealt = rows.withColumn("__block", F.floor(F.col(order) / block))
    counts = dealt.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(order)) - 1
    out = dealt.withColumn("__own", own).join(offsets, [*keys, "__block"])
    return out.withColumn(name, F.col("__base") + F.col("__own")).drop("__block", "__own", "__base")
