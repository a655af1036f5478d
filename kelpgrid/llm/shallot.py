"""Exact k-means of integer vectors by Shallot search.

Every vector keeps the number of its centroid, of the second nearest one when it was
last searched, an upper bound of its distance to the first and a lower bound of its distance
to all others.  After centroids moved, the bounds move with them, and a vector whose upper bound is under
its lower bound keeps its centroid unseen.  For the others the distances to the two remembered centroids
are computed; the search starts from the closer one and walks its neighbours, nearest to
that centroid first.  No centroid farther from it than the sum of the vector's distances to it and to the
second nearest so far can be among the two nearest, so this ball shrinks while the search goes on.
What survives is compared by squared distances in integers; equal ones go to the smaller number.

Vectors and their bounds are written once for each assignment, together with the sums of each
task's vectors by centroid, so each round reads its rows once and shuffles only such sums.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgrid.llm.vectors import matrix, scaled, usable
from kelpgrid.session import discard, materialize

CLUSTERS, ROUNDS, LENGTH, SCALE, SEED = 40, 5, 64, 256, 2
LARGEST = 1 << 27  # of an integer entry: squared distances of 64 entries then fit a long
SLACK = 1e-9  # bounds are widened by this share, far over their rounding
STATE = "v array<long>, first int, second int, upper double, lower double"
SUMS = "cluster int, n long, total array<decimal(38,0)>"


@dataclass
class Centroids:
    """Centroids as integers, with how far each moved in the last round."""

    at: np.ndarray
    moved: np.ndarray

    def __post_init__(self):
        self.k = len(self.at)
        apart = np.sqrt(((self.at[:, None, :] - self.at[None, :, :]).astype(np.float64) ** 2).sum(2))
        self.order = np.argsort(apart, axis=1, kind="stable")
        # A centroid comes first in its own list even if another lies on it.
        self.order = np.array([[c, *row[row != c]] for c, row in enumerate(self.order)]).reshape(self.k, self.k)
        self.apart = np.take_along_axis(apart, self.order, 1)
        # The farthest move of any other centroid.
        self.others = np.array([np.delete(self.moved, c).max(initial=0.0) for c in range(self.k)])

    def squares(self, v: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((v - self.at[c]) ** 2).sum(1)


def search(v: np.ndarray, centroids: Centroids, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """(nearest, second nearest, their squared distances) of each row of ``v``, from the two remembered centroids."""
    n = len(v)
    a, b = first.copy(), second.copy()
    da, db = centroids.squares(v, a), centroids.squares(v, b)
    swap = (db < da) | ((db == da) & (b < a))
    a[swap], b[swap], da[swap], db[swap] = b[swap], a[swap], db[swap], da[swap]
    start, reach = a.copy(), np.sqrt(da.astype(np.float64))
    live = np.arange(n)
    for j in range(1, centroids.k):
        ball = (reach[live] + np.sqrt(db[live].astype(np.float64))) * (1 + SLACK)
        live = live[centroids.apart[start[live], j] <= ball]
        if not len(live):
            break
        c = centroids.order[start[live], j]
        new = (c != second[live]) & (c != first[live])
        at, c = live[new], c[new]
        d = centroids.squares(v[at], c)
        wins = (d < da[at]) | ((d == da[at]) & (c < a[at]))
        up, cu, du = at[wins], c[wins], d[wins]
        b[up], db[up] = a[up], da[up]
        a[up], da[up] = cu, du
        runner = ~wins & ((d < db[at]) | ((d == db[at]) & (c < b[at])))
        at, c, d = at[runner], c[runner], d[runner]
        b[at], db[at] = c, d
    return a, b, da, db


def assign(v: np.ndarray, centroids: Centroids, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The state of each row of ``v`` after the last move of the centroids: first, second, upper, lower."""
    if centroids.k == 1:
        zero = np.zeros(len(v), np.int32)
        return zero, zero, np.full(len(v), np.inf), np.full(len(v), np.inf)
    upper = (upper + centroids.moved[first]) * (1 + SLACK)
    lower = (lower - centroids.others[first]) * (1 - SLACK)
    first, second = first.astype(np.int64), second.astype(np.int64)
    open_ = np.flatnonzero(~(upper < lower))
    upper[open_] = np.sqrt(centroids.squares(v[open_], first[open_]).astype(np.float64)) * (1 + SLACK)
    open_ = open_[~(upper[open_] < lower[open_])]
    a, b, da, db = search(v[open_], centroids, first[open_], second[open_])
    first[open_], second[open_] = a, b
    upper[open_], lower[open_] = np.sqrt(da.astype(np.float64)) * (1 + SLACK), np.sqrt(db.astype(np.float64)) * (1 - SLACK)
    return first.astype(np.int32), second.astype(np.int32), upper, lower


def _round(centroids: Centroids):
    """Assign the vectors of a task; after them come its sums by centroid, in rows without a vector."""
    k, d = centroids.at.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        large = [[0] * d for _ in range(k)]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = matrix(batch.column(1))
            first, second, upper, lower = assign(v, centroids, *(batch.column(i).to_numpy(zero_copy_only=False).copy() for i in range(2, 6)))
            order = np.argsort(first, kind="stable")
            found, begin = np.unique(first[order], return_index=True)
            count[found] += np.diff(np.append(begin, n))
            total[found] += np.add.reduceat(v[order], begin, axis=0)
            if np.abs(total).max(initial=0) > 1 << 61:
                large, total = [[x + int(y) for x, y in zip(*p)] for p in zip(large, total)], np.zeros((k, d), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(first), pa.array(second), pa.array(upper), pa.array(lower), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
                 pa.nulls(n, pa.list_(pa.decimal128(38, 0)))], names=["vec_id", "v", "first", "second", "upper", "lower", "cluster", "n", "total"])
            kind = batch.schema.field(0).type
        full = np.flatnonzero(count)
        if len(full):
            m = len(full)
            sums = [[Decimal(x + int(y)) for x, y in zip(large[c], total[c])] for c in full]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, kind), pa.nulls(m, pa.list_(pa.int64())), *[pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.float64(), pa.float64())],
                 pa.array(full.astype(np.int32)), pa.array(count[full]), pa.array(sums, pa.list_(pa.decimal128(38, 0)))],
                names=["vec_id", "v", "first", "second", "upper", "lower", "cluster", "n", "total"])

    return run


def _distances(at: np.ndarray):
    def run(batches):
        for batch in batches:
            first = batch.column(2)
            d = ((matrix(batch.column(1)) - at[first.to_numpy()]) ** 2).sum(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), first, pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``; null ids last, rows that repeat an id by their vectors."""
    drawn = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    top = drawn.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    return np.array([r["v"] for r in top], np.int64)


def moved_centroids(table: DataFrame, centroids: Centroids) -> Centroids:
    """Centroids at the exact floor of the mean of their vectors; empty ones stay.  The driver gets k x dimensions sums."""
    sums = table.filter("n is not null").select("cluster", "n", F.posexplode("total").alias("i", "s"))
    at = centroids.at.copy()
    for r in sums.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        at[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return Centroids(at, np.sqrt(((at - centroids.at).astype(np.float64) ** 2).sum(1)) * (1 + SLACK))


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, length: int = LENGTH, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each usable row of ``vectors``.

    Usable are vectors of ``length`` entries, none null or non-finite, and under 2^19 in size, so
    that squared distances fit a long.  With fewer than ``k`` of them there are as many clusters as vectors; an empty
    table gives no rows.  Repeated rows count each, ids may be null or repeated; other columns are ignored.
    The sums of distances are null where they do not fit a long.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))
    rows = rows.filter(usable(F.col("v"), LARGEST / SCALE) & (F.size("v") == length))
    kind = rows.schema["vec_id"].dataType.simpleString()
    rows = rows.select("vec_id", scaled(F.col("v"), SCALE).alias("v"))
    at = first_centroids(rows, k, seed)
    if not len(at):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k = len(at)
    centroids = Centroids(at, np.zeros(k))
    state = rows.select("vec_id", "v", F.lit(0).alias("first"), F.lit(min(1, k - 1)).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    table = None
    for _ in range(rounds + 1):
        if table is not None:
            centroids = moved_centroids(table, centroids)
            state = table.filter("n is null").select("vec_id", *[c.split()[0] for c in STATE.split(", ")])
        last, table = table, materialize(state.mapInArrow(_round(centroids), f"vec_id {kind}, {STATE}, {SUMS}"))
        if last is not None:
            discard(last)
    state = table.filter("n is null").select("vec_id", "v", "first")
    placed = materialize(state.mapInArrow(_distances(centroids.at), f"vec_id {kind}, cluster int, distance long"))
    discard(table)
    # One row for each cluster, k at most.
    names = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.at.tolist())], "cluster int, centroid_sha256 string")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    whole = sums.agg(F.sum("s").try_cast("long").alias("inertia"))
    sums = sums.select("cluster", F.col("s").try_cast("long").alias("cluster_inertia")).crossJoin(F.broadcast(whole)).join(F.broadcast(names), "cluster")
    return placed.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
