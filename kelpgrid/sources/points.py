"""Readers and parsers of point records; writer of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the input formats.
REFERENCE_TIME = "2008-02-02 18:44:58"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
TIME_PATTERN = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
POINT_PATTERN = r"POINT \(([^\s]+) ([^\s]+)\)"
UNIT_MS = 100000.0


def scan_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).withColumnRenamed("value", "line")


def list_inputs(scan: DataFrame) -> DataFrame:
    """Files of a scan with their row counts."""
    return scan.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))


def list_files(spark: SparkSession, paths: list[str], pattern: str = "*") -> DataFrame:
    """``(file, bytes, modified)`` of the files below ``paths`` whose names fit ``pattern``; no file is opened.

    Files without a byte hold no rows and are not listed.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def encode_time(ts: Column) -> Column:
    """Timestamp -> units of 100 seconds since the reference instant (session zone UTC)."""
    return (F.unix_millis(ts) - F.unix_millis(F.to_timestamp(F.lit(REFERENCE_TIME), TIME_FORMAT))) / F.lit(UNIT_MS)


def _point(line: str) -> tuple[Column, Column]:
    return tuple(F.nullif(F.regexp_extract(line, POINT_PATTERN, i), F.lit("")).try_cast("double") for i in (1, 2))


def _time(text: Column) -> Column:
    return encode_time(F.try_to_timestamp(text, F.lit(TIME_FORMAT)))


def parse_wkt_line(lines: DataFrame, line: str = "line") -> DataFrame:
    """First date and first POINT anywhere in the line; unreadable parts are null."""
    x, y = _point(line)
    when = F.nullif(F.regexp_extract(line, TIME_PATTERN, 1), F.lit(""))
    return lines.withColumns({"x": x, "y": y, "t": _time(when)})


def parse_taxi_csv(lines: DataFrame, line: str = "line") -> DataFrame:
    """id,time,x,y"""
    part = F.split(line, ",")
    return lines.withColumns({"x": F.get(part, 2).try_cast("double"), "y": F.get(part, 3).try_cast("double"), "t": _time(F.get(part, 1))})


def parse_trip_csv(lines: DataFrame, line: str = "line") -> DataFrame:
    """Time in the fourth field, POINT anywhere in the line."""
    x, y = _point(line)
    return lines.withColumns({"x": x, "y": y, "t": _time(F.get(F.split(line, ","), 3))})


def reject_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("x").isNull() | F.col("y").isNull() | F.col("t").isNull())


def write_labels(labels: DataFrame, path: str) -> int:
    """Write the labeled points and return how many there are."""
    labels.write.mode("overwrite").parquet(path)
    return labels.sparkSession.read.parquet(path).count()
