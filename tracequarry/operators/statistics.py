"""Overlap-weighted statistics and weighted midpoint percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .overlap import attach_samples, slice_rows


def weighted_percentiles(rows: DataFrame, keys: list[str], value: str, weight: str, order: str, points: dict[str, float]) -> DataFrame:
    """(``keys``, one column per point): the weighted midpoint percentiles of ``value``.

    A value's midpoint is the weight before it plus half its own, values being ordered
    by (value, ``order``). The percentile is met at the first midpoint that reaches its
    share of the whole weight, and interpolated from the midpoint before; beyond the
    last midpoint it is the last value.
    """
    ranked = Window.partitionBy(*keys).orderBy(value, order)
    whole = Window.partitionBy(*keys)
    cum = F.sum(weight).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    r = rows.withColumns({"__mid": cum - F.col(weight) / F.lit(2.0), "__all": F.sum(weight).over(whole)})
    r = r.withColumns({"__before": F.lag("__mid").over(ranked), "__value": F.lag(value).over(ranked), "__last": F.lead("__mid").over(ranked).isNull()})
    picks = []
    for name, share in points.items():
        goal = F.col("__all") * F.lit(float(share))
        here = (F.col("__mid") >= goal) & (F.col("__before").isNull() | (F.col("__before") < goal))
        step = (goal - F.col("__before")) / (F.col("__mid") - F.col("__before"))
        found = F.when(F.col("__before").isNotNull() & (F.col("__mid") > F.col("__before")), F.col("__value") + (F.col(value) - F.col("__value")) * step).otherwise(F.col(value))
        picks.append(F.coalesce(F.max(F.when(here, found)), F.max(F.when(F.col("__last"), F.col(value)))).alias(name))
    return r.groupBy(*keys).agg(*picks)


def overlap_statistics(scopes: DataFrame, samples: DataFrame, metric_samples: DataFrame, on: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Statistics of every metric in every scope, weighted by the time that a sample and the scope share.

    Scopes without any usable value keep a row with nulls and a coverage of 0. The
    validity of samples decides the slice alone; rows within it count if they overlap.
    The smallest value's index is the first one, the largest value's the last one.
    """
    keys = [*(on or []), "id", "metric"]
    slices = attach_samples(scopes, samples, on, width)
    metrics = metric_samples.select(*(on or []), "metric").distinct()
    base = slices.join(metrics, on) if on else slices.crossJoin(F.broadcast(metrics))
    base = base.select(*keys, "start_ns", "end_ns", (F.col("sample_stop") - F.col("sample_start")).alias("selected_samples"))
    m = metric_samples.select(*(on or []), "metric", "range_index", F.col("start_ns").alias("m_start"), F.col("end_ns").alias("m_end"), "value")
    rows = slice_rows(slices.select(*(on or []), "id", "start_ns", "end_ns", "sample_start", "sample_stop"), m, on)
    rows = rows.withColumn("w", F.least("end_ns", "m_end") - F.greatest("start_ns", "m_start")).where("w > 0 and value is not null and not isnan(value)")
    return _summary(base, rows, keys)


def _summary(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    percentiles = weighted_percentiles(rows, keys, "value", "w", "range_index", {"p50": 0.5, "p95": 0.95})
    whole = Window.partitionBy(*keys)
    mean = F.sum(F.col("value") * F.col("w")).over(whole) / F.sum("w").over(whole)
    sums = rows.withColumn("mean", mean).groupBy(*keys).agg(
        F.count("*").alias("valid_samples"), F.sum("w").alias("weight"), F.first("mean").alias("mean"),
        F.sqrt(F.sum(F.col("w") * F.pow(F.col("value") - F.col("mean"), F.lit(2.0))) / F.sum("w")).alias("stddev"),
        F.min("value").alias("min"), F.min_by("range_index", F.struct("value", "range_index")).alias("min_index"),
        F.max("value").alias("max"), F.max_by("range_index", F.struct("value", "range_index")).alias("max_index"),
        F.sum("value").alias("sum"),
    )
    length = F.col("end_ns") - F.col("start_ns")
    covered = F.coalesce("weight", F.lit(0)) * F.lit(100.0) / length
    coverage = F.when(length > 0, F.least(F.lit(100.0), covered)).otherwise(F.lit(0.0))
    out = base.join(sums, keys, "left").join(percentiles, keys, "left")
    return out.select(
        *keys, F.coalesce("valid_samples", F.lit(0)).alias("valid_samples"), "selected_samples", coverage.alias("coverage_pct"),
        "mean", "stddev", "min", "min_index", "max", "max_index", "p50", "p95", "sum",
    )


def metric_scan(metric_samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per metric over all its samples: counts, means, extremes, percentiles, spread and burst ratio.

    Coverage is by number of samples. Durations weigh the mean and the percentiles,
    with 1 for samples without valid times; the deviation is not weighted. The peak is
    the first maximum.
    """
    keys = [*(by or []), "metric"]
    weight = F.when(F.col("timestamp_valid"), F.greatest("duration_ns", F.lit(1))).otherwise(F.lit(1)).cast("bigint")
    rows = metric_samples.withColumn("w", weight)
    good = F.col("value").isNotNull() & ~F.isnan("value")
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("selected_samples"), F.count_if(good).alias("valid_samples"), F.count_if(good & (F.col("value") != 0)).alias("nonzero_samples"),
        F.avg(F.when(good, F.col("value"))).alias("sample_mean"),
        (F.sum(F.when(good, F.col("value") * F.col("w"))) / F.sum(F.when(good, F.col("w")))).alias("time_weighted_mean"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("stddev"),
        F.min_by("range_index", F.when(good, F.struct(-F.col("value"), F.col("range_index")))).alias("peak_sample_index"),
    )
    points = weighted_percentiles(rows.where(good), keys, "value", "w", "range_index", {"p50": 0.5, "p95": 0.95})
    out = sums.join(points, keys, "left")
    coverage = F.when(F.col("selected_samples") > 0, F.col("valid_samples") * F.lit(100.0) / F.col("selected_samples")).otherwise(F.lit(0.0))
    burst = F.when(F.col("time_weighted_mean") > 0, F.col("p95") / F.col("time_weighted_mean"))
    return out.withColumns({"sample_coverage_pct": coverage, "burst_ratio": burst})


def scan_header(samples: DataFrame) -> DataFrame:
    valid = F.col("timestamp_valid")
    return samples.agg(
        F.count("*").alias("selected_samples"), F.count_if(valid).alias("timestamped_samples"), F.count_if("complete").alias("complete_samples"),
        F.sum(F.when(valid, F.col("duration_ns"))).alias("sample_duration_ns"),
    )


def pressure(mean: Column, fallback: Column) -> Column:
    return F.coalesce(mean, fallback)
