"""Metric values in tumbling windows over a stream: an extension, the traces that are analysed elsewhere are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_scan(values: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Per window and metric: counts, mean, extremes. ``values`` has ``ts``, ``metric`` and ``value``; rows later than ``late`` are left out, missing values count as selected only."""
    good = F.col("value").isNotNull() & ~F.isnan("value")
    return (
        values.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "metric")
        .agg(
            F.count("*").alias("selected_samples"), F.count_if(good).alias("valid_samples"), F.avg(F.when(good, F.col("value"))).alias("mean"),
            F.min("value").alias("min"), F.max("value").alias("max"),
        )
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "metric", "selected_samples", "valid_samples", "mean", "min", "max")
    )
