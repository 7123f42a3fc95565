"""Rule-based top-down diagnostics over a metric scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import metric_category, metric_kind

# fixed values: metrics of activity and of elapsed time, in the order in which they are looked for
ACTIVE = ("gr__cycles_active", "gpu__cycles_active", "sm__cycles_active")
ELAPSED = ("gr__cycles_elapsed", "sm__cycles_elapsed")


def described(scan: DataFrame) -> DataFrame:
    base = F.regexp_extract("metric", r"^([^.]*)", 1)
    out = scan.withColumns({"base": base, "kind": metric_kind(F.col("metric"))})
    return out.withColumns({"category": metric_category(F.col("base")), "mean": F.coalesce("time_weighted_mean", "sample_mean")})


def category_summary(scan: DataFrame, top: int = 3) -> DataFrame:
    """Per category: metrics with values, those above 0 at times, and its ``top`` throughputs by pressure: the p95, else the mean."""
    s = described(scan).where("valid_samples > 0")
    pressure = F.coalesce("p95", "mean")
    order = Window.partitionBy("category", "kind").orderBy(pressure.desc_nulls_last(), "metric")
    s = s.withColumn("rank", F.row_number().over(order))
    best = F.array_sort(F.collect_list(F.when((F.col("kind") == "throughput") & (F.col("rank") <= top), F.struct("rank", "metric"))))
    return s.groupBy("category").agg(
        F.count("*").alias("available"), F.count_if(F.col("nonzero_samples") > 0).alias("nonzero"), F.concat_ws(",", F.transform(best, lambda b: b["metric"])).alias("top_throughputs")
    )


def findings(scan: DataFrame) -> DataFrame:
    """Pressure findings: each category's hottest throughput if its mean, or else its p95, reaches 60, with half of the samples covered."""
    s = described(scan).where("valid_samples > 0 and kind = 'throughput'")
    order = Window.partitionBy("category").orderBy(F.coalesce("p95", "mean").desc_nulls_last(), "metric")
    hottest = s.withColumn("rank", F.row_number().over(order)).where("rank = 1 and sample_coverage_pct >= 50")
    severity = F.when(F.col("mean") >= 80, "high").when(F.col("mean") >= 60, "medium").when(F.col("p95") >= 80, "high").when(F.col("p95") >= 60, "medium")
    rule = F.when(F.col("mean") >= 60, "sustained").otherwise("burst")
    return hottest.select("category", "metric", severity.alias("severity"), rule.alias("rule"), "mean", "p95").where("severity is not null")


def low_hit_rates(scan: DataFrame, most: int = 3) -> DataFrame:
    """The lowest cache hit ratios below one half, in categories under a pressure of 20 and more."""
    s = described(scan).where("valid_samples > 0")
    lead = Window.partitionBy("category").orderBy(F.coalesce("p95", "mean").desc_nulls_last(), "metric")
    load = s.where("kind = 'throughput'").withColumn("r", F.row_number().over(lead)).where("r = 1").select("category", F.coalesce("mean", F.lit(0.0)).alias("pressure"))
    low = s.where("kind = 'ratio' and nonzero_samples > 0 and sample_coverage_pct >= 50 and mean < 0.5").where(F.lower("base").contains("hit_rate"))
    return low.join(load, "category").where("pressure >= 20").orderBy("mean", "metric").limit(most).select("category", "metric", "mean", "pressure")


def throughput_cluster(scan: DataFrame, first: int = 5, within: float = 10.0) -> DataFrame:
    """Of the ``first`` throughputs by pressure those within ``within`` points of the leader."""
    s = described(scan).where("valid_samples > 0 and kind = 'throughput'").withColumn("pressure", F.coalesce("p95", "mean"))
    s = s.orderBy(F.col("pressure").desc_nulls_last(), "metric").limit(first)
    lead = F.max("pressure").over(Window.partitionBy())
    return s.withColumn("behind", lead - F.col("pressure")).where(F.col("behind") <= within).select("metric", "pressure", "behind")


def activity_ratio(scan: DataFrame) -> DataFrame:
    """Active by elapsed cycles, from the first metric of each list that has a mean; between 0 and 1, null without elapsed time."""
    s = described(scan)
    mean = lambda names: F.coalesce(*[F.max(F.when(F.col("base") == n, F.col("mean"))) for n in names])
    got = s.agg(mean(ACTIVE).alias("active"), mean(ELAPSED).alias("elapsed"))
    return got.withColumn("active_ratio", F.when(F.col("elapsed") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("active") / F.col("elapsed")))))
