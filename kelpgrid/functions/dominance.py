"""Counting and summing over dominated rows without listing pairs.

For every row r: an aggregate over the rows s of its group that come earlier in
one order and have a smaller rank in another.  Ranks are read as digits in base
8; two ranks differ first in exactly one digit, so one running aggregate per
digit level gives the exact answer in O(n log n) rows, each level a skew-safe
two-level scan (see ``ordering``).
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions.ordering import grouped, join_rows, with_row_number, with_running
from kelpgrid.session import materialize

BITS = 3
# Rows of one value range that a task orders, and the most ranges a group is cut into.
RANGE_ROWS, MAX_RANGES = 1 << 15, 256


def dominated(df: DataFrame, keys: list[str], first: list[str], second: list[str], row: str,
              aggs: dict[str, tuple[str, str | Column]]) -> DataFrame:
    """``df`` plus, per row, aggregates over rows smaller in both total orders.

    ``first`` and ``second`` must be total orders inside the group (end them with
    a unique column); ``row`` identifies a row inside its group; functions are
    ``sum``, ``count``, ``min`` and ``max`` of a column.
    """
    base = df
    for name, (_, col) in aggs.items():
        base = base.withColumn(f"__d_{name}", F.col(col) if isinstance(col, str) else col)
    ranked = with_row_number(base, keys, second, "__rb")
    ranked = with_row_number(ranked, keys, first, "__ra")
    ranked = materialize(ranked.select(*keys, row, "__ra", (F.col("__rb") - 1).alias("__rb"), *[f"__d_{n}" for n in aggs]))
    top = ranked.agg(F.max("__rb")).first()[0] or 0
    levels = max(1, -(-int(top).bit_length() // BITS))
    size = 1 << BITS
    lv = ranked.withColumn("__l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    lv = lv.withColumn("__d", F.expr(f"shiftright(__rb, {BITS} * __l) & {size - 1}")).withColumn(
        "__p", F.expr(f"shiftright(__rb, {BITS} * (__l + 1))"))
    run = {}
    for name, (f, _) in aggs.items():
        for d in range(size - 1):
            run[f"__r_{name}_{d}"] = (f, F.when(F.col("__d") == d, F.col(f"__d_{name}")))
    lv = with_running(lv, [*keys, "__l", "__p"], ["__ra"], run, exclusive=True)
    out = []
    for name, (f, _) in aggs.items():
        below = [F.when(F.col("__d") > d, F.col(f"__r_{name}_{d}")) for d in range(size - 1)]
        if f in ("sum", "count"):
            level = sum((F.coalesce(b, F.lit(0)) for b in below), F.lit(0))
            out.append(F.sum(level).alias(name))
        else:
            pick, agg = (F.least, F.min) if f == "min" else (F.greatest, F.max)
            out.append(agg(pick(*below)).alias(name))
    return join_rows(df, lv.groupBy(*keys, row).agg(*out), [*keys, row])


def lowest_below(df: DataFrame, keys: list[str], orders: list[list[str]], row: str, value: str, name: str) -> DataFrame:
    """``df`` plus the least ``value`` of the rows that are smaller in all ``orders``, two or more total orders of the group.

    The first order is scanned, each other one is read as digits like in ``dominated``: with n
    rows and k orders the scans see n log(n)^(k-1) rows, and pairs of rows are never listed.
    """
    bits = {1: 3, 2: 2}.get(len(orders) - 1, 1)
    size, ranks = 1 << bits, [f"__r{i}" for i in range(len(orders))]
    ranked = df
    for rank, order in zip(ranks, orders):
        ranked = with_row_number(ranked, keys, order, rank)
    ranked = materialize(ranked.select(*keys, row, F.col(value).alias("__v"), *[(F.col(c) - 1).alias(c) for c in ranks]))
    top = ranked.agg(F.max(ranks[0])).first()[0] or 0
    levels = max(1, -(-int(top).bit_length() // bits))
    lv, groups, digits = ranked, [], []
    for c in ranks[1:]:
        lv = lv.withColumn(f"{c}l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
        lv = lv.withColumn(f"{c}d", F.expr(f"shiftright({c}, {bits} * {c}l) & {size - 1}")).withColumn(f"{c}p", F.expr(f"shiftright({c}, {bits} * ({c}l + 1))"))
        groups += [f"{c}l", f"{c}p"]
        digits.append(F.col(f"{c}d"))
    # A row with the last digit is below none, one with the first digit has none below.
    lv = lv.filter((F.least(*digits, F.lit(size)) > 0) | (F.greatest(*digits, F.lit(0)) < size - 1))
    run, below = {}, []
    for spot in product(range(size - 1), repeat=len(digits)):
        at = "__m_" + "_".join(map(str, spot))
        run[at] = ("min", F.when(_all([d == x for d, x in zip(digits, spot)]), F.col("__v")))
        below.append(F.when(_all([d > x for d, x in zip(digits, spot)]), F.col(at)))
    lv = with_running(lv, [*keys, *groups], [ranks[0]], run, exclusive=True)
    low = F.least(*below) if len(below) > 1 else below[0]
    return join_rows(df, lv.groupBy(*keys, row).agg(F.min(low).alias(name)), [*keys, row])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


# --- pairs smaller in both of two values, as one number per group ------------------------------


def _codes(value: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Dense numbers in the order of (range, value); NaN is one value, the greatest."""
    order = np.lexsort((value, rng))
    v, r = value[order], rng[order]
    new = (v[1:] != v[:-1]) & ~((v[1:] != v[1:]) & (v[:-1] != v[:-1])) | (r[1:] != r[:-1])
    out = np.empty(len(v), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(new)))
    return out


def _rising(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> int:
    """Pairs with a smaller a and a smaller b, by the weight of the greater row: b in the order of a, split bit by bit."""
    order = np.lexsort((-b, a))
    cur, weight = b[order], weight[order]  # equal a: from large to small b, so that they do not count
    total = 0
    for bit in reversed(range(int(cur.max()).bit_length())):
        one, prefix = (cur >> bit) & 1, cur >> (bit + 1)
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        start = np.concatenate(([0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1))
        before = zeros[:-1] - np.repeat(zeros[start], np.diff(np.append(start, len(cur))))
        total += int((one * before * weight).sum())
        order = np.argsort(cur >> bit, kind="stable")
        cur, weight = cur[order], weight[order]
    return total


def _column(t: pa.Table, name: str) -> np.ndarray:
    """A column without nulls; the range of a null (-1) tells it from the value put there."""
    c = t.column(name).combine_chunks()
    return c.fill_null(pa.scalar(0).cast(c.type)).to_numpy(zero_copy_only=False)


def _inside(t: pa.Table) -> pa.Table:
    ra, rb = t.column("__ra").to_numpy(), t.column("__rb").to_numpy()
    n = _rising(_codes(_column(t, "__a"), ra), _codes(_column(t, "__b"), rb), t.column("__w").to_numpy())
    return pa.table({"__g": t.column("__g").slice(0, 1), "n": pa.array([n], pa.int64())})


def _across(t: pa.Table) -> pa.Table:
    """Pairs whose second range is the same, its values ordered, and whose first ranges differ."""
    rb = t.column("__rb").to_numpy()
    n = _rising(t.column("__ra").to_numpy(), _codes(_column(t, "__b"), rb), t.column("__w").to_numpy())
    return pa.table({"__g": t.column("__g").slice(0, 1), "n": pa.array([n], pa.int64())})


def _between(t: pa.Table) -> pa.Table:
    """Pairs of different ranges in both, from the counts of a bounded table of ranges."""
    a, b = (np.unique(t.column(c).to_numpy(), return_inverse=True)[1] for c in ("__ra", "__rb"))
    table, weight = np.zeros((2, a.max() + 1, b.max() + 1), np.int64)
    np.add.at(table, (a, b), t.column("c").to_numpy())
    np.add.at(weight, (a, b), t.column("w").to_numpy())
    n = int((weight[1:, 1:] * table.cumsum(0).cumsum(1)[:-1, :-1]).sum())
    return pa.table({"__g": t.column("__g").slice(0, 1), "n": pa.array([n], pa.int64())})


def _range_of(value: str, splits: str) -> Column:
    """Number of a value's range: even between split points, odd at one, -1 without a value."""
    below = F.size(F.filter(splits, lambda s: s < F.col(value)))
    at = F.array_contains(splits, F.col(value)).cast("long")
    return F.when(F.col(value).isNull(), -1).otherwise(2 * below + F.coalesce(at, F.lit(0))).cast("long")


def rising_pairs(df: DataFrame, keys: list[str], a: str, b: str, name: str, size: int = RANGE_ROWS,
                 weight: str | None = None) -> DataFrame:
    """``(*keys, name)``: pairs of rows of a group of which one is smaller in both ``a`` and ``b``; null is the smallest value.

    Both values are cut into ranges at quantiles of the group; a repeated split point is a range of
    its own, in which nothing is smaller.  A pair lies in one range of a (a task orders its rows by
    a and b), else in one range of b (likewise), else in two of both (a table of counts for each group).
    A row is shuffled twice, whatever the number of rows.  ``weight``: an integer column; a pair counts as often as its greater row says.
    """
    t = materialize(df.select(*keys, F.col(a).alias("__a"), F.col(b).alias("__b"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("__w")))
    counts = materialize(grouped(t, keys, "__of").groupBy("__of").agg(F.count(F.lit(1)).alias("__n")))
    top = counts.agg(F.max("__n")).first()[0] or 0
    ids = materialize(with_row_number(counts.select("__of", "__n", F.xxhash64("__of").alias("__h")), [], ["__h", "__of"], "__g"))
    if top > size:
        parts = min(MAX_RANGES, -(-top // size))
        probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        cuts = materialize(grouped(t, keys, "__of").groupBy("__of").agg(*[
            F.coalesce(F.array_distinct(F.percentile_approx(c, probs, max(1000, 20 * parts))), F.array().cast(f"array<{dict(t.dtypes)[c]}>")).alias(f"{c}s")
            for c in ("__a", "__b")]))
        ids = materialize(ids.join(cuts, "__of"))
    t, out = grouped(t, keys, "__of").join(ids, "__of"), "__g long, n long"
    if top > size:
        t = t.select("__g", "__a", "__b", "__w", _range_of("__a", "__as").alias("__ra"), _range_of("__b", "__bs").alias("__rb"))
        found = t.filter("__ra % 2 = 0").groupBy("__g", "__ra").applyInArrow(_inside, out)
        found = found.unionByName(t.filter("__rb % 2 = 0").select("__g", "__ra", "__rb", "__b", "__w").groupBy("__g", "__rb").applyInArrow(_across, out))
        table = t.groupBy("__g", "__ra", "__rb").agg(F.count(F.lit(1)).alias("c"), F.sum("__w").alias("w"))
        found = found.unionByName(table.groupBy("__g").applyInArrow(_between, out))
    else:  # a group is one range, the nulls before it
        found = t.select("__g", "__a", "__b", "__w", *[F.when(F.col(c).isNull(), -1).otherwise(0).cast("long").alias(r) for c, r in (("__a", "__ra"), ("__b", "__rb"))])
        found = found.groupBy("__g").applyInArrow(_inside, out)
    sums = found.groupBy("__g").agg(F.sum("n").alias(name))
    sums = ids.select("__g", "__of").join(sums, "__g").select("__of", name)
    return sums.select(*[F.col(f"__of.k{i}").alias(k) for i, k in enumerate(keys)], name)
