"""Run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import c
from ..functions.text import count_label, eta_label, progress_label, rate_label
from .quantiles import exact_quantiles

THRESHOLDS = (-0.5, -0.3, -0.1, 0.0)  # fixed values


def collection_summary(df: DataFrame, title: str = "log_type") -> DataFrame:
    """Rows per title and, with a null title, in total."""
    return df.rollup(c(title).alias("title")).agg(F.count(F.lit(1)).alias("n_logs"))


def at_thresholds(scored: DataFrame, thresholds=THRESHOLDS, score: str = "anomaly_score") -> DataFrame:
    """Every scored event once per threshold, with ``is_anomaly``; a map-side expansion by a handful of constants."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    return scored.withColumn("threshold", each).withColumn("is_anomaly", c(score) < F.col("threshold"))


def threshold_sweep(scored: DataFrame, by: list[str] | None = None, thresholds=THRESHOLDS, score: str = "anomaly_score") -> DataFrame:
    """Events, anomalies and anomaly rate per threshold.

    All thresholds are counted side by side in one aggregate, so no event is multiplied.
    """
    keys = [c(k) for k in by or []]
    wide = scored.where(c(score).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        *[F.count_if(c(score) < float(t)).alias(f"t{i}") for i, t in enumerate(thresholds)],
    )
    entries = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("anomalies")) for i, t in enumerate(thresholds)]
    return wide.select(*keys, "events", F.inline(F.array(*entries))).withColumn(
        "anomaly_rate", F.col("anomalies") / F.col("events")
    )


def latency_report(results: DataFrame, by: list[str], seconds: str, success: str) -> DataFrame:
    """Requests, success rate in percent, and mean, min, max, median and sample deviation of response times.

    Times count for successful requests only; the median is exact.
    """
    ok = F.when(c(success), c(seconds))
    keys = [c(k) for k in by]
    stats = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        (F.avg(F.when(c(success), 1.0).otherwise(0.0)) * 100).alias("success_rate"),
        F.avg(ok).alias("avg_time"),
        F.min(ok).alias("min_time"),
        F.max(ok).alias("max_time"),
        F.stddev_samp(ok).alias("std_time"),
    )
    medians = exact_quantiles(results.select(*keys, ok.alias("value")), by, {"median_time": 0.5})
    return stats.join(medians, by, "left")


def run_labels(runs: DataFrame, rows: Column, seconds: Column, percent: Column, estimated: Column) -> DataFrame:
    """Add the texts of a progress line: counts, rate and remaining time."""
    return runs.withColumns(
        {
            "current_label": progress_label(rows),
            "estimated_label": count_label(estimated),
            "rate": rate_label(rows, seconds),
            "eta": eta_label(seconds, percent),
        }
    )
