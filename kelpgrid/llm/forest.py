"""Nearest neighbours through a forest of random-projection trees.

The trees are fitted on a bounded sample: every node cuts its rows at the middle of their
projections on a random direction.  Every row of the table is filed under its leaf in every tree.
A query walks all trees through one priority queue: a node waits with the sum of squares of the
margins by which the query lies on the other side, so the most promising branch of any tree is next.  It
takes leaves until they hold a share of the rows that was measured beforehand: on the sample,
against brute force, the share at which ``recall`` of the true neighbours are met.  As neighbours get closer with more rows,
this share is on the safe side for the whole table.

Rows and queries meet in cells of a leaf.  A leaf with many rows or many queries is dealt
over as many cells as keep both sides bounded, so each row of a leaf is compared however many it
holds.  Cells rerank by exact distances of the original vectors and hand on the best of each query.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpgrid.llm.common import PART, ROW, numbered
from kelpgrid.llm.vectors import common_length, matrix, usable
from kelpgrid.session import materialize

K = 10
BOUND = 1e150  # of an entry; squares then fit a double


@dataclass(frozen=True)
class Settings:
    trees: int = 8
    leaf: int = 32  # sampled rows in a leaf
    sample: int = 16_384  # rows that the trees are fitted on
    trials: int = 128  # sampled rows that measure the share
    recall: float = 0.97
    rows: int = 16_384  # of a leaf in one cell, about
    queries: int = 4_096
    seed: int = 42


@dataclass
class Tree:
    """Inner nodes by number; a child below zero is leaf ``-child - 1``."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0 if len(self.cuts) else -1, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -node - 1
            elif len(at):
                over = x[at] @ self.normals[node] > self.cuts[node]
                todo += [(self.children[node, 1], at[over]), (self.children[node, 0], at[~over])]
        return out


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree over the rows of ``x``; rows that no direction tells apart share a leaf."""
    normals, cuts, children, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), None, 0)]
    while todo:
        at, parent, side = todo.pop()
        cut = None
        if len(at) > leaf:
            way = rng.standard_normal(x.shape[1])
            way /= np.linalg.norm(way)
            p = np.sort(x[at] @ way)
            steps = np.flatnonzero(np.diff(p) > 1e-9 * (np.abs(p[[0, -1]]).max() + 1e-300))
            if len(steps):  # the step nearest the middle
                s = steps[np.abs(steps + 1 - len(p) / 2).argmin()]
                cut = (p[s] + p[s + 1]) / 2
        if cut is None:
            leaves += 1
            node = -leaves
        else:
            node = len(cuts)
            normals.append(way)
            cuts.append(cut)
            children.append([0, 0])
            over = x[at] @ way > cut
            todo += [(at[over], node, 1), (at[~over], node, 0)]
        if parent is not None:
            children[parent][side] = node
    return Tree(np.array(normals).reshape(-1, x.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), leaves)


class Forest:
    """Trees whose leaves are numbered through: leaf ``i`` of tree ``t`` is ``first[t] + i``."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.first = np.cumsum([0, *(t.leaves for t in trees)])
        self.children = [t.children.tolist() for t in trees]

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([t.leaf_of(x) + self.first[i] for i, t in enumerate(self.trees)], 1)

    def walk(self, x: np.ndarray, counts: np.ndarray, limit: float):
        """For each row of ``x`` the leaves taken, in order, until they hold ``limit`` rows by ``counts``."""
        margins = [(x @ t.normals.T - t.cuts).tolist() for t in self.trees]
        counts, first = counts.tolist(), self.first.tolist()
        for q in range(len(x)):
            waiting = [(0.0, t, 0 if len(tree.cuts) else -1) for t, tree in enumerate(self.trees)]
            taken, held = [], 0
            while waiting and held < limit:
                far, t, node = heapq.heappop(waiting)
                own, tree = margins[t][q], self.children[t]
                while node >= 0:
                    margin, (low, high) = own[node], tree[node]
                    node, other = (high, low) if margin > 0 else (low, high)
                    heapq.heappush(waiting, (far + margin * margin, t, other))
                leaf = first[t] - node - 1
                taken.append(leaf)
                held += counts[leaf]
            yield taken


def best_rows(d: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest of each row of ``d``, in no order."""
    return np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]


def measured_share(forest: Forest, x: np.ndarray, settings: Settings, k: int = K) -> float:
    """Rows that a query has to take, as a share of all, to meet ``recall`` of its ``k`` nearest in the sample ``x``.

    A row counts once for each tree in which it is taken, so the share may exceed 1.
    """
    if len(x) < 2:
        return float(len(forest.trees))
    chosen = np.random.default_rng(settings.seed).choice(len(x), min(settings.trials, len(x)), replace=False)
    d = (x[chosen] ** 2).sum(1)[:, None] - 2 * x[chosen] @ x.T + (x ** 2).sum(1)
    d[np.arange(len(chosen)), chosen] = np.inf
    near = best_rows(d, min(k, len(x) - 1))
    leaves = forest.leaves_of(x)
    counts = np.bincount(leaves.ravel(), minlength=forest.first[-1])
    needed = []
    for taken, own in zip(forest.walk(x[chosen], counts, np.inf), near):
        held = np.zeros(forest.first[-1])
        held[taken] = np.cumsum(counts[taken])
        needed.append(held[leaves[own]].min(1))
    return float(np.quantile(np.concatenate(needed), settings.recall)) / len(x)


def fit(rows: DataFrame, settings: Settings, k: int = K) -> tuple[Forest, float]:
    """Trees on the ``sample`` rows of ``rows(vec_id, v)`` with the smallest hashes, and the share of rows to take."""
    few = rows.orderBy(F.xxhash64("vec_id", "v", F.lit(settings.seed))).limit(settings.sample).select("v").toArrow()
    x = np.array(few.column(0).to_pylist(), np.float64)
    rng = np.random.default_rng(settings.seed)
    forest = Forest([grow(x, settings.leaf, rng) for _ in range(settings.trees)])
    return forest, measured_share(forest, x, settings, k)


def _filed(forest: Forest):
    def run(batches):
        for batch in batches:
            leaves = forest.leaves_of(matrix(batch.column(2)).astype(np.float64)) if batch.num_rows else np.zeros((0, len(forest.trees)))
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * len(forest.trees)), pa.array(leaves.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "leaves"])

    return run


def _walked(forest: Forest, counts: np.ndarray, limit: float):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                taken = [np.array(t, np.int32) for t in forest.walk(matrix(part.column(2)).astype(np.float64), counts, limit)]
                at = pa.array(np.repeat(np.arange(len(taken)), [len(t) for t in taken]))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns), pa.array(np.concatenate(taken))], names=[*part.schema.names, "leaf"])

    return run


def _reranked(k: int):
    """Of the rows of a cell the ``k`` nearest of each of its queries, by exact distance, ties by id and row."""
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query", "query_id", "row", "vec_id", "score"]
        out = [[], [], [], [], []]
        if rows.num_rows and asked.num_rows:
            r, q = (matrix(t.column("v").combine_chunks()).astype(np.float64) for t in (rows, asked))
            own, seeker = rows.column("row").to_numpy(), asked.column("row").to_numpy()
            ids = rows.column("vec_id").combine_chunks()
            last = np.iinfo(np.int64).max
            key = ids.fill_null(last).to_numpy()
            size = (r ** 2).sum(1)
            rough = 1e-9 * (size.max() + (q ** 2).sum(1).max())
            for i in range(0, len(q), 256):
                part = q[i:i + 256]
                d = (part ** 2).sum(1)[:, None] - 2 * part @ r.T + size
                d[seeker[i:i + 256, None] == own] = np.inf
                near = np.take_along_axis(d, best_rows(d, k), 1)
                for j, limit in enumerate(near.max(1, where=np.isfinite(near), initial=-np.inf)):
                    near = np.flatnonzero(d[j] <= limit + rough)
                    exact = np.sqrt(((r[near] - part[j]) ** 2).sum(1))
                    best = np.lexsort((own[near], key[near], exact))[:k]
                    n = len(best)
                    for c, v in zip(out, (np.full(n, seeker[i + j]), np.full(n, i + j), own[near[best]], near[best], exact[best])):
                        c.append(v)
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        at = asked.column("vec_id").combine_chunks().take(pa.array(flat[1].astype(np.int64))) if out[0] else pa.nulls(0, pa.int64())
        to = ids.take(pa.array(flat[3].astype(np.int64))) if out[0] else pa.nulls(0, pa.int64())
        return pa.Table.from_arrays([pa.array(flat[0].astype(np.int64)), at, pa.array(flat[2].astype(np.int64)), to, pa.array(flat[4].astype(np.float64))], names=names)

    return run


def cells(filed: DataFrame, asked: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Both sides with (leaf, i, j): rows of a leaf are dealt over its ``i``, queries over its ``j``, and each meets all of the other side."""
    sizes = filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")), "leaf")
    # One row for each leaf, as many as the sample gave trees.
    sizes = F.broadcast(sizes.select("leaf", F.ceil(F.col("n") / settings.rows).cast("int").alias("is"), F.ceil(F.col("m") / settings.queries).cast("int").alias("js")))

    def spread(name: str) -> Column:
        return F.pmod(F.xxhash64("row"), F.col(name)).cast("int")

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    left = filed.join(sizes, "leaf").withColumn("i", spread("is")).withColumn("j", every("js")).drop("is", "js")
    right = asked.join(sizes, "leaf").withColumn("j", spread("js")).withColumn("i", every("is")).drop("is", "js")
    return left, right


def neighbours(vectors: DataFrame, is_query: Column, k: int = K, settings: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of each row that ``is_query`` (of ``vec_id``) picks, nearest first.

    ``score`` is the Euclidean distance in double precision.  Vectors that are null, empty, zero or hold null,
    non-finite or entries of 1e150 and more take no part, and of vectors of several lengths only those of the most common length do.
    A query does not find its own row, but rows that repeat it.  Ties go to the smaller id, null ids last; with
    fewer than ``k`` other rows all are found; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    rows = rows.filter(usable(F.col("v"), BOUND) & F.exists("v", lambda c: c != 0))
    rows = rows.filter(F.size("v") == common_length(rows, "v"))
    spot = numbered(rows)
    rows = spot.select(F.shiftleft(F.col(PART).cast("long"), 33).bitwiseOR(F.col(ROW)).alias("row"), "vec_id", "v")
    if rows.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest, share = fit(rows, settings, k)
    kind = rows.schema["v"].dataType.simpleString()
    filed = materialize(rows.mapInArrow(_filed(forest), f"row long, vec_id long, v {kind}, leaves array<int>"))
    held = filed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each leaf
    counts = np.zeros(forest.first[-1], np.int64)
    for r in held:
        counts[r["leaf"]] = r["n"]
    limit = share * counts.sum() / len(forest.trees)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = rows.filter(is_query).repartition(tasks, "row")
    asked = materialize(picked.mapInArrow(_walked(forest, counts, limit), f"row long, vec_id long, v {kind}, leaf int"))
    left, right = cells(filed.select("row", "vec_id", "v", F.explode("leaves").alias("leaf")), asked, settings)
    place = ["leaf", "i", "j"]
    met = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(_reranked(k), "query long, query_id long, row long, vec_id long, score double")
    # A row meets a query once in each tree at most, so k * trees places hold the k best different rows.
    order = [F.col("score"), F.col("vec_id").asc_nulls_last(), F.col("row")]
    by_query = Window.partitionBy("query").orderBy(*order)
    met = met.withColumn("place", F.row_number().over(by_query)).filter(F.col("place") <= k * len(forest.trees))
    met = met.withColumn("again", F.lag("row").over(by_query).eqNullSafe(F.col("row"))).filter(~F.col("again"))
    met = met.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return met.select("query_id", "rank", "vec_id", "score")
