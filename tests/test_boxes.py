"""Marginals and shares of forests against grids and closed forms."""

from itertools import product

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from kelpgrid.operators import boxes as B

DOMAIN = {"a": (0.0, 8.0), "b": (0.0, 4.0), "k": ["x", "y", "z"]}


@pytest.fixture(scope="module")
def forest(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 9)), float(rng.integers(0, 5)), float(rng.integers(0, 3))) for _ in range(400)]
    df = spark.createDataFrame([(*r, r[0] * r[1] + 10 * (r[2] == 1) + r[0]) for r in rows], "a double, b double, k double, y double")
    vec = VectorAssembler(inputCols=["a", "b", "k"], outputCol="raw").transform(df)
    vec = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=3).fit(vec).transform(vec)
    return RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=4, seed=5).fit(vec)


def predictor(boxes):
    """Value of tree t at a point, from the boxes."""
    def at(t, a, b, k):
        hits = [r["value"] for r in boxes if r["tree"] == t and (r["sides"]["a"]["lo"] < a <= r["sides"]["a"]["hi"])
                and r["sides"]["b"]["lo"] < b <= r["sides"]["b"]["hi"] and k in r["sides"]["k"]["choices"]]
        assert len(hits) == 1
        return hits[0]
    return at


def test_boxes_fill_the_domain_and_predict(spark, forest):
    rows = B.forest_boxes(forest, ["a", "b", "k"], DOMAIN).collect()
    for t in range(4):
        shares = [np.prod([s["share"] for s in r["sides"].values()]) for r in rows if r["tree"] == t]
        assert sum(shares) == pytest.approx(1.0)
    at = predictor(rows)
    for a, b, k in product((0.3, 2.0, 4.7, 8.0), (0.2, 1.0, 3.9), range(3)):
        want = forest.predict(Vectors.dense([a, b, float(k)]))
        assert np.mean([at(t, a, b, DOMAIN["k"][k]) for t in range(4)]) == pytest.approx(want)


def test_shares_of_a_forest(spark, forest):
    boxes = B.forest_boxes(forest, ["a", "b", "k"], DOMAIN)
    rows = boxes.collect()
    at = predictor(rows)
    got = {r["params"]: r for r in B.model_shares(boxes, ["a", "b", "k"], 3).collect()}
    individual = {}
    for t in range(4):
        axes = []
        for p in ("a", "b"):
            ends = sorted({e for r in rows if r["tree"] == t for e in (r["sides"][p]["lo"], r["sides"][p]["hi"])})
            axes.append([((x + y) / 2, (y - x) / (DOMAIN[p][1] - DOMAIN[p][0])) for x, y in zip(ends, ends[1:])])
        axes.append([(c, 1 / 3) for c in DOMAIN["k"]])
        f = np.array([[[at(t, a, b, k) for k, _ in axes[2]] for b, _ in axes[1]] for a, _ in axes[0]])
        w = [np.array([x[1] for x in ax]) for ax in axes]
        mean = np.einsum("abk,a,b,k", f, *w)
        total = np.einsum("abk,a,b,k", (f - mean) ** 2, *w)
        own = {}
        for name, keep in (("a", "a"), ("b", "b"), ("k", "k"), ("a,b", "ab"), ("a,k", "ak"), ("b,k", "bk"), ("a,b,k", "abk")):
            out = [x for x in "abk" if x not in keep]
            m = np.einsum(f"abk,{','.join(out)}->{keep}", f, *[w["abk".index(x)] for x in out]) if out else f
            v = np.einsum(f"{keep},{','.join(keep)}", (m - mean) ** 2, *[w["abk".index(x)] for x in keep])
            own[name] = max(0.0, v - sum(own[o] for o in own if set(o.split(",")) < set(name.split(","))))
            individual.setdefault(name, []).append((own[name] / total, v / total))
    assert set(got) == set(individual)
    for name, pairs in individual.items():
        single, whole = zip(*pairs)
        assert got[name]["individual"] == pytest.approx(np.mean(single), abs=1e-9)
        assert got[name]["total"] == pytest.approx(np.mean(whole), abs=1e-9)
        assert got[name]["individual_std"] == pytest.approx(np.std(single), abs=1e-9)
        assert got[name]["total_std"] == pytest.approx(np.std(whole), abs=1e-9)
    assert got["a,b,k"]["total"] == pytest.approx(1.0)


def two_leaves(spark):
    """One tree cut at a = 2 (values 0 and 8), one tree of a single leaf."""
    df = spark.createDataFrame([(0, 0, 0.0, None, 2.0), (0, 1, 8.0, 2.0, None), (1, 0, 5.0, None, None)], "tree int, leaf int, value double, lo double, hi double")
    sides = F.create_map(F.lit("a"), B.side(DOMAIN["a"], "lo", "hi"), F.lit("b"), B.side(DOMAIN["b"]), F.lit("k"), B.side(DOMAIN["k"]))
    return df.select("tree", "leaf", "value", sides.alias("sides"))


def test_marginal_at_points(spark):
    got = B.model_marginal(two_leaves(spark), DOMAIN, {"a": [0.0, 2.0, 2.5, 8.0, 9.0], "k": ["y", "none"]}).collect()
    assert {(r["a"], r["k"]): (r["mean"], r["std"]) for r in got} == {
        (0.0, "y"): (2.5, 2.5), (2.0, "y"): (2.5, 2.5), (2.5, "y"): (6.5, 1.5), (8.0, "y"): (6.5, 1.5)}


def test_trees_without_variance(spark):
    boxes = two_leaves(spark)
    got = {r["params"]: (r["individual"], r["total"]) for r in B.model_shares(boxes, ["a", "b"], 2).collect()}
    assert got["a"] == (pytest.approx(1.0), pytest.approx(1.0)) and got["b"][0] == 0 and got["a,b"][0] == pytest.approx(0, abs=1e-12)
    assert B.model_shares(boxes.filter("tree = 1"), ["a", "b"], 2).count() == 0
    assert B.model_shares(boxes.filter("tree = 7"), ["a", "b"], 2).count() == 0


def test_grid():
    assert B.grid((1.0, 100.0), 3, log=True) == [1.0, pytest.approx(10.0), 100.0]
    assert B.grid((0.0, 1.0), 5) == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert B.grid(["p", "q"], 5) == ["p", "q"]
    for bad in ((0.0, 1.0, 5, True), (1.0, 2.0, 1, False)):
        with pytest.raises(ValueError):
            B.grid(bad[:2], *bad[2:])
