"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # tables of materialize and their folders


def configure(spark: SparkSession) -> SparkSession:
    """Pin the time zone; all timestamps in this package are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a fresh local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read on from there.

    Used where a result is consumed several times or inside a loop: the plan is
    cut, values such as sampled split points cannot drift on a recomputation, a
    lost executor costs one read of the file instead of the whole lineage, and
    the written size lets the planner choose broadcast joins safely.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    WRITTEN[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned; for tables of a finished round that nothing reads again."""
    path = WRITTEN.pop(df, None)
    if path is not None:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def bucket_count(spark: SparkSession) -> int:
    """Number of order buckets: one per shuffle partition, between 8 and 10,000."""
    return max(8, min(10_000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
