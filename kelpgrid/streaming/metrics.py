"""Streaming form of the metric series: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from kelpgrid.operators.metrics import metric_series


def stream_metric_series(spark: SparkSession, folder: str, schema: StructType, interval: str, late: str) -> DataFrame:
    """Read files of ``(metric, ts, value)`` as they arrive; rows later than ``late`` are left out."""
    log = spark.readStream.schema(schema).parquet(folder)
    return metric_series(log.withWatermark("ts", late), interval)
