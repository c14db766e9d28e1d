"""Rolling evaluation windows and the spread of metrics across them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane.functions.scalar import window_label
from pitlane.functions.stats import sample_std
from pitlane.operators.metrics import METRICS, PERCENT_METRICS, metrics_long


def rolling_windows(
    spark: SparkSession, start: str, end: str, *, window_years: int = 5, step_months: int = 12
) -> DataFrame:
    """Windows of fixed length, stepped by months, that fit entirely between start and end.

    Month arithmetic keeps the day where it can and clamps it where it cannot.
    """
    if window_years < 1:
        raise ValueError(f"window_years must be >= 1, got {window_years}")
    if step_months < 1:
        raise ValueError(f"step_months must be >= 1, got {step_months}")
    span = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("z"))
    steps = F.sequence(
        F.lit(0), F.greatest(F.floor(F.months_between("z", "a") / step_months).cast("int"), F.lit(0))
    )
    at = span.select("a", "z", F.explode(steps).alias("window_id"))
    begin = F.add_months("a", F.col("window_id") * step_months)
    return (
        at.select("z", "window_id", begin.alias("start"))
        .withColumn("end", F.add_months("start", 12 * window_years))
        .where((F.col("end") <= F.col("z")) & (F.col("end") > F.col("start")))
        .select("window_id", "start", "end", window_label("start", "end").alias("label"))
    )


def long_enough(timeline: DataFrame, rebalance_every: int, *, by: Sequence[str] = ("window_id",)) -> DataFrame:
    """Windows with at least two rebalance periods of trading days."""
    return timeline.groupBy(*by).agg(F.count(F.lit(1)).alias("n_days")).where(
        F.col("n_days") >= 2 * rebalance_every
    )


def metric_spread(wide: DataFrame, *, by: Sequence[str] = ("strategy",), names: Sequence[str] = METRICS) -> DataFrame:
    """Mean, deviation, min, median and max of every metric over the windows of a strategy.

    Undefined values are left out, not counted as zero; a metric with no value
    has no row. Percent metrics are scaled by 100. There is one row per window
    and run, so a group is as long as the list of windows.
    """
    long = metrics_long(wide, by=by, names=names).where(F.col("value").isNotNull())
    scale = F.when(F.col("metric").isin(*PERCENT_METRICS), F.lit(100.0)).otherwise(F.lit(1.0))
    scaled = long.withColumn("value", F.col("value") * scale)
    return scaled.groupBy(*by, "metric").agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("value").alias("mean"), sample_std("value").alias("std"),
        F.min("value").alias("min"), F.median("value").alias("median"), F.max("value").alias("max"),
    )


def per_window(wide: DataFrame, metric: str) -> DataFrame:
    """One metric by window in order of time, as text with four digits or ``n/a``."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    shown = F.when(F.col(metric).isNull(), "n/a").otherwise(F.format_string("%.4f", F.col(metric)))
    return wide.select("strategy", "start", window_label("start", "end").alias("label"), shown.alias("value")).orderBy(
        "strategy", "start"
    )
