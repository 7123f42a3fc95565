"""Ranking of scopes, regions and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_scopes(statistics: DataFrame, statistic: str = "mean", descending: bool = True, top: int = 8, evidence: list[str] | None = None) -> DataFrame:
    """The ``top`` scopes of each metric by one statistic; scopes with equal ``evidence`` columns collapse into one, up to 20 equivalents being listed."""
    value = F.col(statistic)
    s = statistics.where(value.isNotNull())
    if evidence:
        s = s.groupBy("metric", *evidence).agg(F.min(F.struct("id", value.alias("value"))).alias("b"), F.slice(F.array_sort(F.collect_list("id")), 2, 20).alias("equivalents"))
        s = s.select("metric", "b.id", "b.value", "equivalents")
    else:
        s = s.select("metric", "id", value.alias("value"))
    order = Window.partitionBy("metric").orderBy(F.col("value").desc() if descending else F.col("value").asc(), "id")
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, min(100, top)))


def rank_regions(scopes: DataFrame, statistics: DataFrame, scan: DataFrame, top: int = 8) -> DataFrame:
    """Scopes by a score of duration (0.45), metric pressure (0.35) and anomaly (0.20), with the reason that weighs most.

    Pressure is the largest mean relative to the metric's p95 (else its maximum),
    anomaly the largest distance from the metric's mean in deviations, 10 at most. Ties
    go to longer scopes, then by id.
    """
    ref = scan.where("valid_samples > 0").select(
        "metric", F.coalesce("p95", "max").alias("level"), F.coalesce("time_weighted_mean", "sample_mean").alias("usual"), F.col("stddev").alias("spread")
    )
    m = statistics.where("mean is not null").join(ref, "metric")
    m = m.groupBy("id").agg(
        F.max(F.when(F.col("level") > 0, F.col("mean") / F.col("level"))).alias("pressure"),
        F.max(F.when(F.col("spread") > 0, F.least(F.lit(10.0), F.abs((F.col("mean") - F.col("usual")) / F.col("spread"))))).alias("anomaly"),
    )
    s = scopes.select("id", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"))
    longest = F.broadcast(s.agg(F.max("duration_ns").alias("longest")))
    s = s.crossJoin(longest).join(m, "id", "left")
    one = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    s = s.withColumns({
        "d": F.coalesce(F.when(F.col("longest") > 0, F.col("duration_ns") / F.col("longest")), F.lit(0.0)),
        "p": one(F.coalesce("pressure", F.lit(0.0))), "a": one(F.coalesce("anomaly", F.lit(0.0)) / F.lit(5.0)),
    })
    reason = (
        F.when(F.col("pressure").isNull() & F.col("anomaly").isNull(), "duration")
        .when((F.col("p") >= F.col("d")) & (F.col("p") >= F.col("a")), "metric_pressure")
        .when(F.col("a") > F.col("d"), "metric_anomaly")
        .otherwise("duration")
    )
    score = F.lit(0.45) * F.col("d") + F.lit(0.35) * F.col("p") + F.lit(0.20) * F.col("a")
    ranked = s.select("id", "duration_ns", "pressure", "anomaly", score.cast("double").alias("score"), reason.alias("reason"))
    return ranked.orderBy(F.desc("score"), F.col("duration_ns").desc_nulls_last(), "id").limit(max(1, top))


def longest_buckets(buckets: DataFrame, order: list[str], top: int = 20) -> DataFrame:
    return buckets.orderBy(F.col("max_duration_ns").desc_nulls_last(), *order).limit(top)
