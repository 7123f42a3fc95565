"""Comparison of a baseline with a candidate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import metric_kind, metric_priority, relative_change

# fixed values: the congruential generator's seed, factor and step
SEED, FACTOR, STEP = 0x9E3779B97F4A7C15, 6364136223846793005, 1442695040888963407
ROUNDS = 512
MOST_METRICS = 64


def metric_deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Metrics with values in both scans: means, differences, and the order in which they matter."""
    take = lambda df, x: df.where("valid_samples > 0").select("metric", F.coalesce("time_weighted_mean", "sample_mean").alias(f"mean_{x}"), F.col("p95").alias(f"p95_{x}"), F.col("sample_coverage_pct").alias(f"coverage_{x}"))
    both = take(baseline, "a").join(take(candidate, "b"), "metric")
    base = F.regexp_extract("metric", r"^([^.]*)", 1)
    return both.select(
        "metric", "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("delta"), relative_change(F.col("mean_a"), F.col("mean_b")).alias("relative_pct"),
        (F.col("p95_b") - F.col("p95_a")).alias("p95_delta"), (F.col("coverage_b") - F.col("coverage_a")).alias("coverage_delta"),
        metric_priority(metric_kind(F.col("metric")), base).alias("priority"),
    )


def ranked_deltas(deltas: DataFrame, top: int = 8) -> DataFrame:
    size = F.greatest(F.abs("relative_pct"), F.abs("delta"))
    return deltas.orderBy(F.desc("priority"), size.desc_nulls_last(), "metric").limit(top)


def match_scopes(baseline: DataFrame, candidate: DataFrame, top: int = 8) -> DataFrame:
    """Scopes (``id``, ``label``, ``duration_ns``) of both sides by label and occurrence among the longest of each side."""

    def take(df: DataFrame, x: str) -> DataFrame:
        few = df.orderBy(F.col("duration_ns").desc_nulls_last(), "id").limit(4 * max(top, 8))
        n = F.row_number().over(Window.partitionBy("label").orderBy(F.col("duration_ns").desc_nulls_last(), "id")) - 1
        return few.select("label", n.alias("occurrence"), F.col("id").alias(f"id_{x}"), F.col("duration_ns").alias(f"duration_{x}"))

    both = take(baseline, "a").join(take(candidate, "b"), ["label", "occurrence"])
    return both.withColumns({"duration_delta": F.col("duration_b") - F.col("duration_a"), "duration_pct": relative_change(F.col("duration_a"), F.col("duration_b"))})


def match_items(baseline: DataFrame, candidate: DataFrame, keys: list[str], order: str, content: str) -> DataFrame:
    """Full outer match by ``keys`` and occurrence: added, removed, changed or unchanged by ``content``."""

    def take(df: DataFrame, x: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
        return df.select(*keys, n.alias("occurrence"), F.col(content).alias(x), F.lit(True).alias(f"in_{x}"))

    both = take(baseline, "a").join(take(candidate, "b"), [*keys, "occurrence"], "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return both.select(*keys, "occurrence", change.alias("change"))


def scope_metric_deltas(matched: DataFrame, baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """For each matched pair of scopes and metric: means, difference, relative change and coverage on both sides.

    ``matched`` has ``id_a`` and ``id_b``; the others are statistics by scope ``id`` and
    ``metric``. A side without statistics has no mean and a coverage of 0.
    """
    take = lambda df, x: df.select(F.col("id").alias(f"id_{x}"), "metric", F.col("mean").alias(f"mean_{x}"), F.col("coverage_pct").alias(f"coverage_{x}"))
    names = baseline.select("metric").union(candidate.select("metric")).distinct()
    rows = matched.crossJoin(F.broadcast(names.limit(MOST_METRICS)))
    both = rows.join(take(baseline, "a"), ["id_a", "metric"], "left").join(take(candidate, "b"), ["id_b", "metric"], "left")
    return both.select(
        *matched.columns, "metric", "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("delta"), relative_change(F.col("mean_a"), F.col("mean_b")).alias("relative_pct"),
        F.coalesce("coverage_a", F.lit(0.0)).alias("coverage_a"), F.coalesce("coverage_b", F.lit(0.0)).alias("coverage_b"),
    )


def ranked_scopes(deltas: DataFrame, top: int = 8) -> DataFrame:
    """Matched scopes (``id_a``, ``id_b``, ``duration_pct``) by the greater of their change of duration and of any metric, the ``top`` first."""
    score = F.greatest(F.coalesce(F.abs(F.first("duration_pct")), F.lit(0.0)), F.coalesce(F.max(F.abs("relative_pct")), F.lit(0.0)))
    return deltas.groupBy("id_a", "id_b").agg(score.alias("score")).orderBy(F.desc("score"), "id_a").limit(max(1, top))


def ordered_changes(items: DataFrame, top: int = 50) -> DataFrame:
    """Matched items: changed ones first, then added, removed and unchanged."""
    rank = F.when(F.col("change") == "changed", 0).when(F.col("change") == "added", 1).when(F.col("change") == "removed", 2).otherwise(3)
    rest = [c for c in items.columns if c != "change"]
    return items.withColumn("rank", rank).orderBy("rank", *rest).limit(top)


def capture_reference(checks: DataFrame) -> DataFrame:
    """One row: the worst status and the checks that didn't pass, worst first."""
    bad = F.array_sort(F.collect_list(F.when(F.col("status") != "pass", F.struct((-F.col("rank")).alias("r"), F.concat_ws(": ", "code", "status").alias("text")))))
    return checks.agg(F.max_by("status", "rank").alias("quality"), F.concat_ws(", ", F.transform(bad, lambda b: b["text"])).alias("checks"))


def comparability(baseline: DataFrame, candidate: DataFrame, identity: list[str]) -> DataFrame:
    """Differences of (``name``, ``value``) settings, nulls being equal; comparable unless one of ``identity`` differs."""
    both = baseline.select("name", F.col("value").alias("a")).join(candidate.select("name", F.col("value").alias("b")), "name", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).withColumn("blocks", F.col("name").isin(identity))


def draws(n: int, start: int = SEED) -> np.ndarray:
    """The first ``n`` states of the generator, all at once: products and sums wrap as unsigned 64-bit numbers."""
    a = np.cumprod(np.full(n, FACTOR, np.uint64))
    p = np.concatenate([np.ones(1, np.uint64), a[:-1]]) if n else a
    return a * np.uint64(start) + np.uint64(STEP) * np.cumsum(p, dtype=np.uint64)


def bootstrap_interval(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, method: str = "compat") -> tuple[float, float] | None:
    """Bounds of the difference of weighted means, b less a, over 512 resamples; None with fewer than two values on a side. A resample without weight has mean 0.

    ``compat`` draws indexes from the generator's low bits, whose period is short for
    sizes that are powers of two; any other method draws from PCG64 with a fixed seed.
    """
    if len(a) < 2 or len(b) < 2:
        return None
    n = len(a) + len(b)
    if method == "compat":
        x = draws(ROUNDS * n).reshape(ROUNDS, n)
        i, j = (x[:, : len(a)] % np.uint64(len(a))).astype(np.int64), (x[:, len(a) :] % np.uint64(len(b))).astype(np.int64)
    else:
        rng = np.random.default_rng(SEED & 0xFFFFFFFF)
        i, j = rng.integers(0, len(a), (ROUNDS, len(a))), rng.integers(0, len(b), (ROUNDS, len(b)))
    mean = lambda v, w: np.divide((v * w).sum(axis=1), w.sum(axis=1), out=np.zeros(ROUNDS), where=w.sum(axis=1) > 0)
    d = np.sort(mean(b[j], wb[j]) - mean(a[i], wa[i]))
    return float(d[int(ROUNDS * 0.025)]), float(d[int((ROUNDS - 1) * 0.975)])


def bootstrap(samples: DataFrame, method: str = "seeded") -> DataFrame:
    """(``metric``, ``low``, ``high``) for samples (``metric``, ``side`` a or b, ``order``, ``value``, ``w``). One task per metric holds that metric's samples."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order")
        side = lambda x: (rows.loc[rows["side"] == x, "value"].to_numpy(float), rows.loc[rows["side"] == x, "w"].to_numpy(float))
        got = bootstrap_interval(*side("a"), *side("b"), method)
        return pd.DataFrame({"metric": [rows["metric"].iloc[0]], "low": [got[0] if got else None], "high": [got[1] if got else None]})

    return samples.groupBy("metric").applyInPandas(run, "metric string, low double, high double")
