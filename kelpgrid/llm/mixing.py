"""Mixing sources to target weights by budgets over a tree.

The tree has one level for each of ``levels`` (domain, language, source).  A budget
of tokens goes down from the root: children share their parent's budget by weight, but
none gets more than its capacity, the tokens below it times ``max_epochs``.  What a
child cannot take goes to its siblings by weight.  As a parent never gets more than its
own capacity, a shortage climbs to the ancestors only when all siblings are full.

A leaf with quota q and s tokens gives q // s whole epochs and, of the next epoch, the
longest prefix that fits the rest, in an order seeded by leaf, epoch and seed.
Prefixes come from running sums over range partitions, so a leaf with a third of all
rows is spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.llm.common import BASE, PART, ROW, running_index, whole, with_bases
from kelpgrid.session import materialize

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Targets:
    """``weights``: path of a node below the root -> weight among its siblings (others: 1; at least 0).

    ``total``: tokens wanted, or the share ``ratio`` of all tokens.
    """

    weights: dict[tuple[str, ...], float] = field(default_factory=dict)
    ratio: float = 1.0
    total: int | None = None
    max_epochs: int = 2
    seed: int = 42


def count_tokens(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _node(levels) -> Column:
    """A path as one string; null names differ from any text."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in levels]))


def _weight(nodes: DataFrame, depth: int, targets: Targets) -> DataFrame:
    rows = [(list(k), float(w)) for k, w in targets.weights.items() if len(k) == depth]
    if any(w < 0 for _, w in rows):
        raise ValueError("weights are at least 0")
    if not rows:
        return nodes.withColumn("w", F.lit(1.0))
    table = nodes.sparkSession.createDataFrame(rows, "path array<string>, w double").select(F.to_json("path").alias("node"), "w")
    return nodes.join(table, "node", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))


def budgets(leaves: DataFrame, targets: Targets, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``leaves(*levels, supply)`` -> with ``quota``; one row for each leaf, never one for each document.

    Within a parent the children are sorted by capacity per weight; a child is full if the
    budget still suffices when all later ones get as much per weight.
    """
    tree = leaves.withColumn("cap", F.col("supply") * targets.max_epochs)
    total = F.lit(targets.total).cast("double") if targets.total is not None else F.sum("supply") * targets.ratio
    root = tree.agg(F.coalesce(total, F.lit(0.0)).alias("b"), F.coalesce(F.sum("cap"), F.lit(0)).alias("c"))
    parents = root.select(F.lit("[]").alias("parent"), F.least("b", F.col("c").cast("double")).alias("budget"))
    for depth in range(1, len(levels) + 1):
        up = F.lit("[]") if depth == 1 else _node(levels[:depth - 1])
        nodes = tree.groupBy(_node(levels[:depth]).alias("node"), up.alias("parent")).agg(F.sum("cap").alias("cap"))
        nodes = _weight(nodes, depth, targets).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)).cast("double"))
        nodes = nodes.join(parents, "parent").withColumn("r", F.coalesce(F.try_divide("cap", "w"), F.lit(0.0)))
        order = Window.partitionBy("parent").orderBy("r", "node")
        nodes = nodes.withColumns({"caps": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                                   "later": F.coalesce(F.sum("w").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))})
        nodes = nodes.withColumn("full", F.col("caps") + F.col("r") * F.col("later") <= F.col("budget"))
        whole_group = Window.partitionBy("parent")
        left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole_group), F.lit(0.0))
        open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole_group)
        share = F.least("cap", F.coalesce(F.try_divide(left * F.col("w"), open_w), F.lit(0.0)))
        parents = nodes.select(F.col("node").alias("parent"), F.when(F.col("full"), F.col("cap")).otherwise(share).alias("budget"))
        parents = materialize(parents)
    quota = parents.select(F.col("parent").alias("leaf"), F.floor(F.col("budget") + 1e-6).cast("long").alias("quota"))
    return leaves.withColumn("leaf", _node(levels)).join(quota, "leaf")


def mix(docs: DataFrame, targets: Targets, domain: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, epoch, domain, lang, source, n_tokens, supply, quota), one row for each use of a document.

    ``docs`` has ``lang`` and ``source``; null names are nodes of their own.  Texts without words (null,
    empty) have no tokens: they are taken once for each epoch their leaf enters before its
    prefix ends.  Rows that repeat id and text are one document.  An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole(F.col(text))).alias("text_hash"), domain.alias("domain"),
                       F.col("lang"), F.col("source"), count_tokens(F.col(text)).alias("n_tokens"))
    rows = rows.groupBy("doc_id", "text_hash").agg(*[F.first_value(F.struct("domain", "lang", "source", "n_tokens")).alias("x")]).select("doc_id", "text_hash", "x.*")
    rows = materialize(rows.withColumn("leaf", _node(LEVELS)))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    quota = materialize(budgets(leaves, targets).select("leaf", "supply", "quota"))
    rows = rows.join(quota, "leaf").withColumn(
        "epochs", F.coalesce(F.floor(F.try_divide("quota", "supply")), F.lit(0)).cast("long"))
    rows = rows.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("supply"))
    rows = rows.withColumn("turn", F.xxhash64(F.lit(targets.seed), "leaf", "epochs", "doc_id", "text_hash"))
    rows = running_index(rows, ["leaf", "turn", "doc_id", "text_hash"])
    rows = with_bases(rows, F.sum("n_tokens"), ("leaf",))
    inside = F.sum("n_tokens").over(Window.partitionBy("leaf", PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", inside + F.col(BASE))
    uses = F.col("epochs") + F.when((F.col("upto") <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0)
    rows = rows.withColumn("uses", uses).filter("uses > 0")
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1))).select(
        "doc_id", "text_hash", "epoch", *LEVELS, "n_tokens", "supply", "quota")
