"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kelpgrid.functions.ordering import long_table, with_row_number
from kelpgrid.session import materialize

MAX_ROUNDS = 100
# A remainder of at most this many edges is finished inside one task.
LOCAL_EDGES = 200_000


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star step followed by one small-star step; edges keep src > dst."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
    large = (both.join(long_table(low), "src").filter(F.col("dst") > F.col("src"))
             .select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct())
    low2 = large.groupBy("src").agg(F.min("dst").alias("m"))
    moved = large.join(long_table(low2), "src")
    hooked = moved.filter(F.col("dst") != F.col("m")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return hooked.unionByName(low2.select("src", F.col("m").alias("dst"))).distinct()


def _finish(batches):
    """Components of a bounded edge list: minimum labels with pointer jumping."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    e = pd.concat(parts)
    nodes, index = np.unique(np.concatenate([e["src"].to_numpy(), e["dst"].to_numpy()]), return_inverse=True)
    s, d = index[:len(e)], index[len(e):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[s], label[d])
        new = label.copy()
        np.minimum.at(new, s, low)
        np.minimum.at(new, d, low)
        np.minimum.at(new, label[s], low)
        np.minimum.at(new, label[d], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pd.DataFrame({"node": nodes, "root": nodes[label]})


def _numbered(edges: DataFrame, nodes: DataFrame | None, local_edges: int) -> DataFrame:
    """Components over composite vertices, by way of order-preserving numbers."""
    fields = edges.schema["src"].dataType.fieldNames()
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("node"))
    flat = ends.distinct().select("node", *[F.col(f"node.{f}").alias(f"f{i}") for i, f in enumerate(fields)])
    ids = materialize(with_row_number(flat, [], [f"f{i}" for i in range(len(fields))], "num").select("node", "num"))
    e = (edges.join(ids.select(F.col("node").alias("src"), F.col("num").alias("s")), "src")
         .join(ids.select(F.col("node").alias("dst"), F.col("num").alias("d")), "dst"))
    comp = connected_components(e.select(F.col("s").alias("src"), F.col("d").alias("dst")), ids.select(F.col("num").alias("node")), local_edges)
    return (comp.select(F.col("node").alias("num"), F.col("root").alias("top")).join(ids, "num").drop("num")
            .join(ids.select(F.col("num").alias("top"), F.col("node").alias("root")), "top").select("node", "root"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None,
                         local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, root)``, root = smallest node of the component.

    Alternating large-star / small-star joins: every step is a grouped minimum
    (combined before the shuffle) and a join of the edges with one row per node,
    so a vertex with very many edges is split by the adaptive skew join.  Each
    round is written to the checkpoint folder; the loop ends when a round changes
    nothing, and raises rather than return an unfinished result.  Once at most
    ``local_edges`` edges are left (a checked count) one task finishes them.
    ``nodes(node)`` adds isolated vertices.  Vertices are integers, or structs of
    integers, which are numbered in order first.
    """
    if isinstance(edges.schema["src"].dataType, StructType):
        return _numbered(materialize(edges.select("src", "dst").distinct()), nodes, local_edges)
    e = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    e = materialize(e.filter("src <> dst").distinct())
    before = _signature(e)
    simple = e.schema["src"].dataType.typeName() == "long"
    found = None
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        if simple and before[0] <= local_edges:
            found = e.coalesce(1).mapInPandas(_finish, "node long, root long")
            break
        e = materialize(_star_round(e))
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    if found is None:
        found = e.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        found = found.unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("root"))).distinct()
    out = found
    if nodes is not None:
        out = nodes.select("node").distinct().join(long_table(out), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return out


def reachable(components: DataFrame, start: DataFrame) -> DataFrame:
    """Vertices connected to each ``start(node)``, without the start itself.

    The starts are written, so that Spark knows their size and broadcasts few starts, not the components.
    """
    components = materialize(components)
    s = materialize(materialize(start).join(components, "node").select(F.col("node").alias("start"), "root"))
    return components.join(s, "root").filter("node <> start").select("start", "node")
