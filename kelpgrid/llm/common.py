"""Column expressions and prefix sums shared by the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.session import materialize

# ASCII white space; words are the runs of other characters.
BLANK = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
PART, ROW, BASE = "__part", "__row", "__base"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters untouched; plain ASCII takes the fast built-in."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def whole(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def numbered(df: DataFrame) -> DataFrame:
    """Write ``df`` with its partition (``__part``) and a rising number inside it (``__row``).

    Once written both are fixed: a lost executor or a second read cannot change them.
    """
    spot = F.monotonically_increasing_id()
    return materialize(df.withColumn(PART, F.shiftrightunsigned(spot, 33)).withColumn(
        ROW, spot.bitwiseAND(F.lit((1 << 33) - 1))))


def with_bases(rows: DataFrame, total: Column, groups: tuple[str, ...] = ()) -> DataFrame:
    """Add ``__base``: ``total`` of all partitions before a row's own (of its group, if groups are named).

    ``rows`` carries ``__part``.  The totals are one row for each partition (and group
    in it).  Without groups they are as few as the partitions, a bound at which they are
    broadcast, so wide rows stay where they are; with groups Spark chooses the join.
    """
    sums = rows.groupBy(*groups, PART).agg(total.alias("__total"))
    before = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    bases = sums.select(*groups, PART, F.coalesce(F.sum("__total").over(
        before.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias(BASE))
    return rows.join(bases, [*groups, PART]) if groups else rows.join(F.broadcast(bases), PART)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that lets null keys meet; the keys and the other columns of both sides, keys once."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = one if on is None else on & one
    return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])


def running_index(df: DataFrame, order: list[str | Column], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written with ``__part`` and ``__row``."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered(df.repartitionByRange(n, *order).sortWithinPartitions(*order))


def ranked(df: DataFrame, groups: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Row number from 0 inside each group along ``order``, a total order, over range partitions.

    No group is gathered in one task: windows hold the rows of one group in one partition.
    """
    rows = with_bases(running_index(df, [*groups, *order]), F.count(F.lit(1)), tuple(groups))
    inside = F.row_number().over(Window.partitionBy(*groups, PART).orderBy(ROW)) - 1
    return rows.withColumn(name, (inside + F.col(BASE)).cast("long")).drop(PART, ROW, BASE)


def running_total(df: DataFrame, groups: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and with a row inside each group along ``order``, a total order, over range partitions."""
    rows = with_bases(running_index(df, [*groups, *order]), F.sum(value), tuple(groups))
    inside = F.sum(value).over(Window.partitionBy(*groups, PART).orderBy(ROW))
    return rows.withColumn(name, (inside + F.col(BASE)).cast("long")).drop(PART, ROW, BASE)
