"""Nearest rows over vectors of any length, by a metric index: shells around pivots, cut by count.

Every row belongs to its closest pivot.  The rows of a pivot, in order of their
distance to it, are cut into shells of ``SHELL`` rows, however many rows a pivot
has.  For a query at distance D from the pivot no row of a shell [near, far] is
closer than max(D - far, near - D).  A query first searches the shell with the
smallest such bound; the k-th distance found there rules out shells by their
bounds alone, and the others are searched.  The answer is exact.

Queries and rows meet as block against block inside tasks (at most ``SHELL`` of
each); only the k best of a block leave it.  Where distances are all alike, as
in many dimensions without structure, few shells can be ruled out and the work
is queries times rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.functions.ordering import with_row_number
from kelpgrid.session import materialize

PIVOTS = 64
SHELL = 4096
SLACK = 1e-9  # relative slack of the triangle bounds, for rounding


def usable(v: str) -> Column:
    """True for vectors without null or non-finite entries."""
    return F.col(v).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def _to_pivots(df: DataFrame, pivots: np.ndarray, closest: bool) -> DataFrame:
    """Rows with ``pivot`` and ``reach`` (distance): of the closest pivot, or arrays over all pivots."""
    def work(batches):
        for b in batches:
            if not len(b):
                continue
            v = np.stack([np.asarray(x, dtype=float) for x in b["v"]])
            d = np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in pivots], axis=1)
            if closest:
                at = d.argmin(1)
                yield b.assign(pivot=at.astype("int32"), reach=d[np.arange(len(b)), at])
            else:
                yield b.assign(reach=list(d))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + (", pivot int, reach double" if closest else ", reach array<double>")
    return df.mapInPandas(work, schema)


def _search(visits: DataFrame, rows: DataFrame, k: int, id_type: str, skip_same: bool) -> DataFrame:
    """``visits(pivot, shell, q, key, v)`` -> the k best ``(q, id, distance)`` of every visit."""
    def work(queries: pd.DataFrame, shell: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(shell):
            b, ids = np.stack(shell["v"].to_list()).astype(float), shell["id"].to_numpy()
            size = (b * b).sum(1)
            for start in range(0, len(queries), 256):
                part = queries.iloc[start:start + 256]
                a = np.stack(part["v"].to_list()).astype(float)
                own = (a * a).sum(1)
                near = own[:, None] + size[None, :] - 2 * a @ b.T
                slack = 1e-9 * (own + size.max())
                for i, (q, key) in enumerate(zip(part["q"], part["key"])):
                    line = near[i]
                    if skip_same:
                        line = np.where(ids == key, np.inf, line)
                    last = min(k, len(line)) - 1
                    limit = np.partition(line, last)[last] + slack[i]
                    held = np.flatnonzero((line <= limit) & np.isfinite(line))
                    exact = np.sqrt(((b[held] - a[i]) ** 2).sum(1))
                    out += [(q, x, d) for d, x in sorted(zip(exact.tolist(), ids[held].tolist()))[:k]]
        return pd.DataFrame(out, columns=["q", "id", "distance"])

    chunk = F.floor(F.col("q") / SHELL)
    asked = visits.withColumn("chunk", chunk)
    wanted = asked.select(*[F.col(c).alias(f"w_{c}") for c in ("pivot", "shell", "chunk")]).distinct()
    copies = rows.join(wanted, (F.col("pivot") == F.col("w_pivot")) & (F.col("shell") == F.col("w_shell"))).select("pivot", "shell", F.col("w_chunk").alias("chunk"), "id", "v")
    keys = ["pivot", "shell", "chunk"]
    return asked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(work, f"q long, id {id_type}, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_vectors(candidates: DataFrame, evaluated: DataFrame, key: str, vector: str, k: int = 1, other_key: str | None = None,
                    skip_same: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """``(key, rank, id, distance)``: the k rows of ``evaluated`` closest to each candidate, ties to the smaller id.

    All vectors have one length; vectors that are null or hold null or non-finite
    entries take no part.  ``id`` is ``other_key`` of ``evaluated`` (default:
    ``key``).  ``skip_same`` leaves out rows whose id equals the candidate's key.
    Rows that repeat a key are searched one by one.  Candidates find fewer than k
    rows only where there are fewer; without any row the result is empty.
    ``pivots`` bounds what every task holds besides its blocks.
    """
    ev = evaluated.select(F.col(other_key or key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(usable("v"))
    ca = candidates.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(usable("v"))
    ev = materialize(ev)
    id_type = ev.schema["id"].dataType.simpleString()
    chosen = ev.groupBy("v").agg(F.min(F.xxhash64("v")).alias("h")).orderBy("h").limit(pivots).collect()
    if not chosen:
        return ca.select(F.col("key").alias(key), F.lit(0).alias("rank"), F.lit(None).cast(id_type).alias("id"), F.lit(0.0).alias("distance")).filter("false")
    points = np.array([list(r["v"]) for r in chosen], dtype=float)
    numbered = with_row_number(_to_pivots(ev, points, True), ["pivot"], ["reach", "id"], "n")
    rows = materialize(numbered.withColumn("shell", F.floor((F.col("n") - 1) / SHELL)).drop("n"))
    shells = materialize(rows.groupBy("pivot", "shell").agg(F.min("reach").alias("near"), F.max("reach").alias("far")))
    asked = with_row_number(ca.withColumn("h", F.xxhash64("v")), [], ["h", "key"], "q").drop("h")
    asked = materialize(_to_pivots(asked, points, False))
    places = asked.select("q", F.posexplode("reach").alias("pivot", "d")).join(shells, "pivot")
    bound = F.greatest(F.lit(0.0), F.col("d") - F.col("far"), F.col("near") - F.col("d")) - SLACK * (F.col("d") + F.col("far"))
    places = places.select("q", "pivot", "shell", bound.alias("bound"), "d")
    first = places.groupBy("q").agg(F.min_by(F.struct("pivot", "shell"), F.struct("bound", "d", "pivot", "shell")).alias("at"))
    first = materialize(first.select("q", "at.pivot", "at.shell").join(asked.drop("reach"), "q"))
    found = materialize(_search(first, rows, k, id_type, skip_same))
    reached = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
    limits = first.select("q", F.col("pivot").alias("p0"), F.col("shell").alias("s0")).join(reached, "q", "left").select(
        "q", "p0", "s0", F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf")).alias("limit"))
    more = places.join(limits, "q").filter((F.col("bound") <= F.col("limit") * (1 + SLACK)) & ~((F.col("pivot") == F.col("p0")) & (F.col("shell") == F.col("s0"))))
    more = materialize(more.select("q", "pivot", "shell"))
    rest = _search(more.join(asked.drop("reach"), "q"), rows, k, id_type, skip_same)
    best = _best(found.unionByName(rest), k)
    return best.join(asked.select("q", "key"), "q").select(F.col("key").alias(key), "rank", "id", "distance")
