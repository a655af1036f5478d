"""Exact marginals and variance shares of a forest, from the boxes of its leaves.

A box is one leaf of one tree: ``(tree, leaf, value, sides)``.  ``sides`` maps
every parameter to ``(lo, hi, choices, share)``: an interval open below and closed
above, or the categories that reach the leaf, and the part of the parameter's
domain that this is.  The boxes of a tree fill the domain.  Boxes may come from a
fitted Spark forest (``forest_boxes``) or from any table (``side``, ``volume``).

Tables here are as large as the model, not as the data it was fitted on.  Nothing
is integrated by sampling: for a set of parameters the tree's cut points make
cells, and a leaf adds its value to the cells it covers, weighted by its share
of all other parameters.  No two leaves are compared.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce
from itertools import combinations
from operator import mul

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgrid.functions.expressions import col
from kelpgrid.session import materialize, shared_folder

Domain = dict[str, tuple[float, float] | list[str]]
SIDE = "struct<lo:double,hi:double,choices:array<string>,share:double>"


def side(domain: tuple[float, float] | list[str], lo: str | Column | None = None, hi: str | Column | None = None,
         choices: str | Column | None = None) -> Column:
    """One entry of ``sides``; a bound that is not given (or null) is the domain's, bounds outside the domain are cut."""
    if isinstance(domain, tuple):
        low, high = F.lit(float(domain[0])), F.lit(float(domain[1]))
        a = low if lo is None else F.greatest(low, F.least(high, F.coalesce(col(lo), low)))
        b = high if hi is None else F.least(high, F.greatest(low, F.coalesce(col(hi), high)))
        share = F.greatest(F.lit(0.0), b - a) / F.lit(float(domain[1] - domain[0]))
        return F.struct(a.alias("lo"), b.alias("hi"), F.lit(None).cast("array<string>").alias("choices"), share.alias("share")).cast(SIDE)
    every = F.array(*[F.lit(str(c)) for c in domain])
    held = every if choices is None else F.array_intersect(every, F.coalesce(col(choices), every))
    none = F.lit(None).cast("double")
    return F.struct(none.alias("lo"), none.alias("hi"), held.alias("choices"), (F.size(held) / F.lit(float(len(domain)))).alias("share")).cast(SIDE)


def volume(sides: Column, params: Column | None = None) -> Column:
    """Product of the shares of ``params`` (default: of all parameters)."""
    shares = F.transform(F.map_values(sides) if params is None else F.transform(params, lambda p: F.element_at(sides, p)), lambda s: s["share"])
    return F.aggregate(shares, F.lit(1.0), lambda acc, x: acc * x)


def forest_boxes(model: RandomForestRegressionModel, features: list[str], domain: Domain) -> DataFrame:
    """Leaf boxes of a fitted forest; category i of a feature is the i-th entry of its domain.

    The model is written to the shared folder and read as a table of nodes; every
    level of the trees is one join, after which leaves stay and inner nodes are
    replaced by their children.  Leaves outside the domain are left out.
    """
    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.save(path)
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("leaf"), n["prediction"].alias("value"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        F.get(F.array(*[F.lit(f) for f in features]), n["split"]["featureIndex"]).alias("param"),
        n["split"]["leftCategoriesOrThreshold"].alias("cut"), (n["split"]["numCategories"] >= 0).alias("is_choice"))
    nodes = materialize(nodes)
    whole = F.create_map(*[x for p in features for x in (F.lit(p), side(domain[p]))])
    here = nodes.filter("leaf = 0").select("tree", "leaf", whole.alias("sides"))
    levels = F.create_map(*[x for p in features for x in (F.lit(p), F.array(*[F.lit(str(c)) for c in (domain[p] if isinstance(domain[p], list) else [])]).cast("array<string>"))])
    widths = F.create_map(*[x for p in features for x in (F.lit(p), F.lit(
        float(len(domain[p]) if isinstance(domain[p], list) else domain[p][1] - domain[p][0])))])

    def narrowed(left: bool) -> Column:
        def cut(p, s):
            names = F.transform("cut", lambda c: F.get(F.element_at(levels, p), c.cast("int")))
            held = F.array_intersect(s["choices"], names) if left else F.array_except(s["choices"], names)
            at = F.get("cut", 0)
            lo, hi = (s["lo"], F.greatest(s["lo"], F.least(s["hi"], at))) if left else (F.least(s["hi"], F.greatest(s["lo"], at)), s["hi"])
            some = F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), held.alias("choices"), (F.size(held) / F.element_at(widths, p)).alias("share"))
            part = F.struct(lo.alias("lo"), hi.alias("hi"), s["choices"].alias("choices"), ((hi - lo) / F.element_at(widths, p)).alias("share"))
            return F.when(p != F.col("param"), s).when(F.col("is_choice"), some).otherwise(part)
        return F.transform_values("sides", cut)

    for _ in range(max(t.depth for t in model.trees)):
        known = here.join(nodes, ["tree", "leaf"])
        stay = F.array(F.struct("leaf", "sides"))
        down = F.array(F.struct(F.col("left").alias("leaf"), narrowed(True).alias("sides")), F.struct(F.col("right").alias("leaf"), narrowed(False).alias("sides")))
        here = known.select("tree", F.explode(F.when(F.col("left") < 0, stay).otherwise(down)).alias("n")).select("tree", "n.leaf", "n.sides")
    found = here.join(nodes.select("tree", "leaf", "value"), ["tree", "leaf"])
    return materialize(found.filter(volume(F.col("sides")) > 0).select("tree", "leaf", "value", "sides"))


def _covered(boxes: DataFrame) -> DataFrame:
    """Boxes with ``cells``: for each parameter the cells between cut points of the tree (or the categories) that the box covers."""
    long = boxes.select("tree", "leaf", F.explode("sides").alias("param", "s"))
    ends = long.filter("s.choices IS NULL").groupBy("tree", "param").agg(
        F.array_sort(F.array_union(F.collect_set("s.lo"), F.collect_set("s.hi"))).alias("ends"),
        F.max((F.col("s.hi") - F.col("s.lo")) / F.col("s.share")).alias("width"))
    known = long.join(ends, ["tree", "param"], "left")
    inside = F.filter("ends", lambda x: (x >= F.col("s.lo")) & (x < F.col("s.hi")))
    after = F.transform(inside, lambda x: F.get("ends", F.array_position("ends", x).cast("int")))
    steps = F.zip_with(inside, after, lambda a, b: F.struct(a.cast("string").alias("cell"), ((b - a) / F.col("width")).alias("w")))
    kinds = F.transform("s.choices", lambda c: F.struct(c.alias("cell"), (F.col("s.share") / F.size("s.choices")).alias("w")))
    cells = known.select("tree", "leaf", "param", F.when(F.col("s.choices").isNull(), steps).otherwise(kinds).alias("cells"))
    return boxes.join(cells.groupBy("tree", "leaf").agg(F.map_from_entries(F.collect_list(F.struct("param", "cells"))).alias("cells")), ["tree", "leaf"])


def _subsets(params: list[str], order: int) -> Column:
    return F.array(*[F.array(*[F.lit(p) for p in s]) for k in range(1, order + 1) for s in combinations(sorted(params), k)])


def marginal_variance(boxes: DataFrame, params: list[str], order: int = 2) -> DataFrame:
    """``(tree, params, variance, total)``: variance of each tree's marginal over every set of up to ``order`` parameters,
    and the tree's whole variance, both over the domain with equal weight everywhere."""
    weighed = boxes.withColumn("volume", volume(F.col("sides"))).filter("volume > 0")
    means = weighed.groupBy("tree").agg((F.sum(F.col("value") * F.col("volume")) / F.sum("volume")).alias("mean"))
    centred = materialize(weighed.join(means, "tree").withColumn("value", F.col("value") - F.col("mean")).drop("mean"))
    totals = centred.groupBy("tree").agg((F.sum(F.col("value") * F.col("value") * F.col("volume")) / F.sum("volume")).alias("total"))
    none = F.array(F.struct(F.array().cast("array<string>").alias("key"), F.lit(1.0).alias("w")))
    sets = _covered(centred).withColumn("set", F.explode(_subsets(params, order)))
    products = F.aggregate("set", none, lambda acc, p: F.flatten(F.transform(acc, lambda a: F.transform(
        F.element_at("cells", p), lambda c: F.struct(F.concat(a["key"], F.array(c["cell"])).alias("key"), (a["w"] * c["w"]).alias("w"))))))
    rest = F.col("volume") / volume(F.col("sides"), F.col("set"))
    parts = sets.select("tree", F.array_join("set", ",").alias("params"), (F.col("value") * rest).alias("part"), F.explode(products).alias("c"))
    marginal = parts.groupBy("tree", "params", "c.key").agg(F.sum("part").alias("m"), F.max("c.w").alias("w"))
    out = marginal.groupBy("tree", "params").agg((F.sum(F.col("m") * F.col("m") * F.col("w"))).alias("variance"), F.sum(F.col("m") * F.col("w")).alias("m"))
    return out.select("tree", "params", F.greatest(F.lit(0.0), F.col("variance") - F.col("m") * F.col("m")).alias("variance")).join(totals, "tree")


def model_shares(boxes: DataFrame, params: list[str], order: int = 2) -> DataFrame:
    """``(params, individual, total, individual_std, total_std)`` for every set of up to ``order`` parameters.

    ``total`` is the share of a tree's variance that its marginal over the set
    has, ``individual`` that less the individual shares of all smaller sets, at
    least 0; both are means over trees (deviations divide by the number of trees).
    Trees without variance count for nothing; if there is no other, no row is left.
    """
    v = materialize(marginal_variance(boxes, params, order).filter("total > 0"))
    spark = v.sparkSession
    done = v.filter(~F.col("params").contains(",")).withColumn("own", F.col("variance"))
    for k in range(2, order + 1):
        links = [(",".join(s), ",".join(low)) for s in combinations(sorted(params), k) for j in range(1, k) for low in combinations(s, j)]
        link = spark.createDataFrame(links, "params string, part string")
        below = done.select("tree", F.col("params").alias("part"), "own").join(link, "part").groupBy("tree", "params").agg(F.sum("own").alias("below"))
        joint = v.join(below, ["tree", "params"]).withColumn("own", F.greatest(F.lit(0.0), F.col("variance") - F.col("below"))).drop("below")
        done = done.unionByName(joint)
    single, total = F.col("own") / F.col("total"), F.col("variance") / F.col("total")
    return done.groupBy("params").agg(F.avg(single).alias("individual"), F.avg(total).alias("total"),
                                      F.stddev_pop(single).alias("individual_std"), F.stddev_pop(total).alias("total_std"))


def grid(domain: tuple[float, float] | list[str], resolution: int, log: bool = False) -> list:
    """Points of a parameter's domain: its categories, or ``resolution`` values from end to end, equal steps or equal ratios."""
    if isinstance(domain, list):
        return [str(c) for c in domain]
    lo, hi = float(domain[0]), float(domain[1])
    if resolution < 2:
        raise ValueError("a grid has at least 2 points")
    if log and lo <= 0:
        raise ValueError("a logarithmic grid starts above 0")
    step = [i / (resolution - 1) for i in range(resolution)]
    inner = [math.exp(math.log(lo) + s * (math.log(hi) - math.log(lo))) if log else lo + s * (hi - lo) for s in step[1:-1]]
    return [lo, *inner, hi]


def model_marginal(boxes: DataFrame, domain: Domain, points: dict[str, list]) -> DataFrame:
    """Marginal prediction at every combination of ``points`` (parameter -> values): one column per parameter, ``mean`` and
    ``std`` over trees (deviation of the trees' marginals, divided by their number).

    A leaf looks its points up in the given lists; a point outside the domain has no row.
    """
    params = list(points)
    rows = boxes.withColumn("volume", volume(F.col("sides"))).filter("volume > 0")
    rest = F.col("volume") / reduce(mul, [F.element_at("sides", p)["share"] for p in params])
    rows = rows.withColumn("part", F.col("value") * rest)
    for p in params:
        s = F.element_at("sides", F.lit(p))
        values = F.array(*[F.lit(x) for x in points[p]])
        if isinstance(domain[p], tuple):
            first = F.lit(float(domain[p][0]))
            held = F.filter(values, lambda x: ((x > s["lo"]) | ((x == first) & (s["lo"] == first))) & (x <= s["hi"]))
        else:
            held = F.array_intersect(values, s["choices"])
        rows = rows.withColumn(p, F.explode(F.array_distinct(held)))
    trees = rows.groupBy("tree", *params).agg(F.sum("part").alias("m"))
    return trees.groupBy(*params).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))
