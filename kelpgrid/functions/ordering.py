"""Ordered computations that never put a whole group into one task.

``Window.partitionBy(task).orderBy(...)`` sorts each task's rows in a single
Spark task.  When one task owns a third of the table that task is the job.  The
functions here cut the order into value ranges (quantile split points), work per
(group, range), and carry only one small row per (group, range) across ranges.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.session import bucket_count, materialize

BUCKET = "__bucket"
GROUP = "__group"
NULLS_FIRST = -1  # bucket of rows without an order value


def _splits(df: DataFrame, cols: list[str]) -> list[list[float]]:
    """Quantile split points per column; a repeated point gets a range of its own."""
    n = bucket_count(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    found = df.approxQuantile(cols, probs, 0.25 / n)
    out = []
    for points in found:
        cuts: set[float] = set()
        for a, b in zip(points, points[1:]):
            cuts.add(a)
            if a == b:
                cuts.add(math.nextafter(a, math.inf))
        cuts.update(points[-1:])
        out.append([-math.inf, *sorted(cuts), math.inf])
    return out


def _bucketize(df: DataFrame, col: str, splits: list[float], out: str) -> DataFrame:
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def add_order_bucket(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``__bucket``, an integer that never decreases along ``order``.

    The first order column must be numeric; the second one, when numeric, splits
    the ranges that hold a single heavy value of the first.
    """
    types = dict(df.dtypes)
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")

    def is_num(c: str) -> bool:
        return types[c].split("(")[0] in numeric

    if not is_num(order[0]):
        return df.withColumn(BUCKET, F.lit(0).cast("long"))
    cols = [c for c in order[:2] if is_num(c)]
    tmp = df
    for i, c in enumerate(cols):
        tmp = tmp.withColumn(f"__v{i}", F.col(c).cast("double"))
    probe = tmp.select([f"__v{i}" for i in range(len(cols))])
    splits = _splits(probe, probe.columns)
    tmp = _bucketize(tmp, "__v0", splits[0], "__q0")
    code = F.coalesce(F.col("__q0").cast("long"), F.lit(NULLS_FIRST))
    if len(cols) == 2:
        edges = splits[0]
        single = [i for i in range(len(edges) - 1)
                  if math.isfinite(edges[i]) and math.nextafter(edges[i], math.inf) == edges[i + 1]]
        if single:
            tmp = _bucketize(tmp, "__v1", splits[1], "__q1")
            width = len(splits[1]) + 2
            # Within a single value nulls of the second column come first: their codes start at 0.
            sub = F.when(F.col("__q0").isin([float(i) for i in single]), F.coalesce(F.col("__q1").cast("long") + 1, F.lit(0))).otherwise(F.lit(0))
            code = F.coalesce(F.col("__q0").cast("long") * F.lit(width) + sub, F.lit(NULLS_FIRST))
    tmp = tmp.withColumn(BUCKET, code)
    return tmp.drop("__v0", "__v1", "__q0", "__q1")


def grouped(df: DataFrame, keys: list[str], name: str = GROUP) -> DataFrame:
    """Add the keys as one struct, which equals itself where keys are null, so a join on it loses no row."""
    return df.withColumn(name, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("all")))


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` in which null keys meet."""
    return grouped(left, keys, "__join").join(grouped(right, keys, "__join").drop(*keys), "__join", how).drop("__join")


def long_table(df: DataFrame) -> DataFrame:
    """Mark a side of an equi join whose other side is as long as the data: both are sorted, none is broadcast.

    Spark takes the size of a table from its compressed file and does not count the rows that
    ``explode`` adds, so without the mark it may send tables to the driver that do not fit there.
    """
    return df.hint("merge")


def join_rows(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``join_keys`` of two long tables."""
    return join_keys(left, long_table(right), keys, how)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (a global aggregate) to every row."""
    packed = one_row.select(F.struct(*one_row.columns).alias("__one")).scalar()
    out = df.withColumn("__one", packed)
    return out.select(*df.columns, *[F.col(f"__one.{c}").alias(c) for c in one_row.columns])


def _asc(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


_SEED = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def with_running(df: DataFrame, keys: list[str], order: list[str],
                 aggs: dict[str, tuple[str, str | Column]], exclusive: bool = False) -> DataFrame:
    """Running sum / count / min / max per group along ``order``.

    ``aggs`` maps an output name to (function, column).  ``order`` has to be a
    total order inside the group.  With ``exclusive`` the current row is left out.
    """
    src = df
    for name, (_, col) in aggs.items():
        src = src.withColumn(f"__in_{name}", F.col(col) if isinstance(col, str) else col)
    src = grouped(add_order_bucket(src, order), keys)
    per_bucket = src.groupBy(GROUP, BUCKET).agg(
        *[_AGG[f](f"__in_{n}").alias(f"__t_{n}") for n, (f, _) in aggs.items()])
    across = Window.partitionBy(GROUP).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(GROUP, BUCKET, *[
        _SEED[f](f"__t_{n}").over(across).alias(f"__o_{n}") for n, (f, _) in aggs.items()])
    inside = (Window.partitionBy(GROUP, BUCKET).orderBy(*_asc(order))
              .rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow))
    out = src.join(long_table(offsets), [GROUP, BUCKET])
    for name, (f, _) in aggs.items():
        within = _AGG[f](f"__in_{name}").over(inside)
        if f in ("sum", "count"):
            value = F.coalesce(within, F.lit(0)) + F.coalesce(F.col(f"__o_{name}"), F.lit(0))
        else:
            pick = F.least if f == "min" else F.greatest
            value = pick(within, F.col(f"__o_{name}"))
        out = out.withColumn(name, value)
    return out.drop(GROUP, BUCKET, *[f"__in_{n}" for n in aggs], *[f"__o_{n}" for n in aggs])


def with_row_number(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """``row_number()`` per group along ``order`` (1-based)."""
    return with_running(df, keys, order, {name: ("count", F.lit(1))})


def with_previous(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str]) -> DataFrame:
    """``lag`` of several columns: output name -> input column of the row before."""
    src = grouped(add_order_bucket(df, order), keys)
    rank = F.struct(*[F.col(c) for c in order])  # nulls come first in a struct too
    lasts = src.groupBy(GROUP, BUCKET).agg(
        F.max_by(F.struct(*[F.col(c).alias(o) for o, c in cols.items()]), rank).alias("__last"))
    across = Window.partitionBy(GROUP).orderBy(BUCKET)
    carry = lasts.select(GROUP, BUCKET, F.lag("__last").over(across).alias("__carry"))
    inside = Window.partitionBy(GROUP, BUCKET).orderBy(*_asc(order))
    out = src.join(long_table(carry), [GROUP, BUCKET]).withColumn("__first", F.row_number().over(inside) == 1)
    for o, c in cols.items():
        out = out.withColumn(o, F.when(F.col("__first"), F.col(f"__carry.{o}")).otherwise(F.lag(c).over(inside)))
    return out.drop(GROUP, BUCKET, "__carry", "__first")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    Equal values are counted before the shuffle; positions come from the running
    count over distinct values, so no task ever holds a group's values.  The
    counts are written once because the scan over them reads them three times.
    """
    return count_quantiles(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")), keys, value, "__n", probs)


def count_quantiles(counts: DataFrame, keys: list[str], value: str, count: str, probs: dict[str, float]) -> DataFrame:
    """``quantiles`` of a table that holds every value once per group, with its number of rows."""
    counts = materialize(counts.select(*keys, value, F.col(count).alias("__n")))
    cum = with_running(counts, keys, [value], {"__cum": ("sum", "__n")})
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    joined = join_keys(cum, totals, keys) if keys else attach_row(cum, totals)
    picks = []
    for name, q in probs.items():
        pos = (F.col("__total") - 1) * F.lit(q)
        picks += [F.min(F.when(F.col("__cum") > F.floor(pos), F.col(value))).alias(f"__lo_{name}"),
                  F.min(F.when(F.col("__cum") > F.ceil(pos), F.col(value))).alias(f"__hi_{name}")]
    out = joined.groupBy(*keys).agg(*picks, F.max("__total").alias("__total"))
    for name, q in probs.items():
        pos = (F.col("__total") - 1) * F.lit(q)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out = out.withColumn(name, lo + (hi - lo) * (pos - F.floor(pos)))
    return out.select(*keys, *probs)


def with_group_stats(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Join per-group aggregates to every row (partial aggregation, no group sort).

    The aggregates are written first, so that Spark knows their size: few groups are broadcast,
    and the rows are not dealt by group, where one group could fill a task.
    """
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return join_keys(df, materialize(stats), keys) if keys else attach_row(df, stats)
