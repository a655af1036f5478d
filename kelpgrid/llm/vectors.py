"""Reading vectors in tasks and summing small matrices over tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, bound: float = float("inf")) -> Column:
    """Not null, not empty, and each entry known, finite and under ``bound`` in size."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(bound)))


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * c) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(factor))).cast("long"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def common_length(df: DataFrame, vector: str) -> int:
    """The length that most vectors have, the larger of equals; 0 of an empty table."""
    top = df.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of int64 without overflow."""
    return [(int(high) << 26) + int(low) for high, low in zip((x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0))]


def summed_matrix(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Entry-wise sum of ``parts(i, row)``, where each task gives each row of its matrix once.

    The sum is made by a shuffle on the place of the entry; as many numbers as ``shape`` has reach the driver.
    """
    out = np.zeros(shape)
    each = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    for r in each.collect():
        out[r["i"], r["j"]] = r["x"]
    return out


def rows_of(m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(m), dtype=np.int32)), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["i", "row"])
