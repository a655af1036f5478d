"""Metric tables: interval series, counter differences, ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions.ordering import with_previous


def metric_series(log: DataFrame, interval: str) -> DataFrame:
    """``log(metric, ts, value)`` -> mean, extremes and count per interval; also valid on a stream."""
    return log.groupBy("metric", F.window("ts", interval).alias("w")).agg(
        F.avg("value").alias("mean"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n")).select(
        "metric", F.col("w.start").alias("start"), "mean", "high", "n")


def counter_delta(log: DataFrame, order: list[str]) -> DataFrame:
    """Difference of successive counter readings per metric (null for the first)."""
    return with_previous(log, ["metric"], order, {"previous": "value"}).withColumn("delta", F.col("value") - F.col("previous"))


def ratio_series(log: DataFrame, interval: str, part: str) -> DataFrame:
    """100 * value of one metric / value of all metrics, per interval."""
    return log.groupBy(F.window("ts", interval).alias("w")).agg(
        F.try_divide(F.lit(100.0) * F.sum(F.when(F.col("metric") == part, F.col("value")).otherwise(0.0)), F.sum("value")).alias("percent")
    ).select(F.col("w.start").alias("start"), "percent")
