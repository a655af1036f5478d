"""Whitening, clustering and neighbour search against brute force on small tables, and on the edge cases their docstrings name."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpgrid.llm import forest, queries, shallot, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, x int, row long, leaf int, first int, n int, cluster string, distance string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 1, 2, 3, 4, 5, "c", "d") for i, v in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    """Bad vectors, repeated rows, a null id, a third of all rows equal, and small integers with many ties."""
    rng = np.random.default_rng(7)
    good = [(i, (rng.integers(-2, 3, 64) / 256).tolist()) for i in range(1, 200)]
    hot = [(1000 + i, good[5][1]) for i in range(150)]
    bad = [(300, None), (301, []), (302, [None] * 64), (303, [float("nan")] * 64), (304, [float("inf")] + [0.5] * 63), (305, [0.5] * 63), (400, [1e30] * 64), (500, [0.0] * 64)]
    return table(spark, [*good, *hot, *bad, good[0], good[99], (None, good[3][1])])


def usable(df, good=lambda v: True):
    return [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()
            if r[1] is not None and len(r[1]) == 64 and all(c is not None and math.isfinite(c) for c in r[1]) and good(r[1])]


# --- 11

def test_inertia_counts():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 40):
        a = rng.standard_normal((n, n))
        a = a + a.T
        for shift in (-3.0, 0.0, 1.5):
            assert whitening.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.above(np.zeros((3, 3)), 0.0) == 0


def spectra():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    yield "spread", q @ np.diag(np.geomspace(1e6, 1e-2, 24)) @ q.T, 12
    yield "equal", q @ np.diag([5.0] * 10 + [2.0] * 10 + [0.0] * 4) @ q.T, 24
    yield "flat", np.eye(24), 24
    yield "one", q @ np.diag([7.0] + [0.0] * 23) @ q.T, 24
    yield "close", q @ np.diag(np.r_[1 + 1e-6 * np.arange(12), 3 + np.arange(12.0)]) @ q.T, 20
    yield "none", np.zeros((24, 24)), 24


@pytest.mark.parametrize("name,v,wanted", list(spectra()), ids=lambda x: x if isinstance(x, str) else "")
def test_contour_integration(spark, name, v, wanted):
    v = (v + v.T) / 2
    want = np.linalg.eigvalsh(v)[::-1]
    wanted_now = min(wanted, int((want > 1e-10 * max(want[0], 1e-300)).sum()))
    e, x = whitening.components(spark, v, wanted)
    assert len(e) == wanted_now and np.allclose(e, want[:len(e)], rtol=1e-9, atol=1e-12 * max(1.0, want[0]))
    assert np.abs(x.T @ x - np.eye(len(e))).max(initial=0) < 1e-7
    assert np.abs(v @ x - x * e).max(initial=0) <= 1e-9 * max(want[0], 1e-300)


def brute_whitening(rows):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    deviation = [int(((n * r - s) ** 2).sum()) for r in x]
    z = (n * x - s).astype(np.float64) / n
    e, c = np.linalg.eigh(z.T @ z / n)
    return deviation, z, e[::-1], c[:, ::-1], np.trace(z.T @ z / n)


def check_whitening(rows, got, k):
    deviation, z, e, c, trace = brute_whitening(rows)
    order = {}
    for i, ((_, v), d) in enumerate(zip(rows, deviation)):
        order.setdefault((rows[i][0], d), []).append(i)
    assert len(got) == len(rows) * k
    white = np.zeros((len(rows), k))
    for r in got:
        at = order[(r["vec_id"], int(r["deviation"]))]
        white[at, r["component"] - 1] = r["whitened"]
        assert r["n"] == len(rows) and r["explained"] == pytest.approx(e[r["component"] - 1] / trace, rel=1e-9) and r["identity_error"] < 1e-8
    want = z @ c[:, :k] / np.sqrt(e[:k])
    want *= np.sign((want * white).sum(0))
    gap = min((e[:k] - e[1:k + 1]) / e[:k]) if k < len(e) else 1e-3
    assert np.abs(want - white).max() < max(1e-9, 1e-11 / gap)


def test_whitening(spark, embeddings):
    check_whitening(usable(embeddings), queries.op11_whitening(spark, SF).collect(), 32)


def test_whitening_edges(spark, edge):
    rows = usable(edge, lambda v: max(map(abs, v)) < 2 ** 40)
    got = whitening.whiten(edge).collect()
    check_whitening(rows, got, 32)
    few = table(spark, [(i, [float(i == j) for j in range(64)]) for i in range(4)])
    out = whitening.whiten(few).collect()
    assert {r["component"] for r in out} == {1, 2, 3} and max(r["identity_error"] for r in out) < 1e-9
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])]):
        assert whitening.whiten(table(spark, rows)).count() == 0
    two = table(spark, [(1, [0.5, 1.0]), (2, [1.5, 7.0]), (3, [0.5, 7.0]), (4, [1.0])])
    assert sorted({r["vec_id"] for r in whitening.whiten(two, wanted=5).collect()}) == [1, 2, 3]


def test_exact_deviation_of_large_numbers():
    centre = whitening.Centre(3, [3 * 10 ** 14, 1])
    x = np.array([[0, 0], [2 * 10 ** 14, 1], [10 ** 14, 0]], np.int64)
    want = [int(((3 * r - np.array([3 * 10 ** 14, 1], object)) ** 2).sum()) for r in x.astype(object)]
    assert [int(d) for d in centre.deviation(x).to_pylist()] == want


# --- 12

def brute_clusters(rows, k=40, rounds=5):
    v = np.array([[math.floor(256 * float(c)) for c in r] for _, r in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest(), v[i].tolist()))
    at = v[order[:k]].copy()
    for step in range(rounds + 1):
        d = ((v[:, None, :] - at[None]) ** 2).sum(2)
        first = d.argmin(1)
        if step < rounds:
            for c in set(first.tolist()):
                own = v[first == c]
                at[c] = own.sum(0) // len(own)
    near = d.min(1)
    sums = np.bincount(first, near, minlength=len(at)).astype(int)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    return sorted(map(repr, ((i, int(c), int(m), int(sums[c]), int(near.sum()), names[c]) for (i, _), c, m in zip(rows, first, near))))


def test_clusters(spark, embeddings):
    assert sorted(repr(tuple(r)) for r in queries.op12_clustering(spark, SF).collect()) == brute_clusters(usable(embeddings))


@pytest.mark.parametrize("k,rounds", [(40, 5), (1, 2), (2, 3), (500, 3), (7, 0)])
def test_clusters_edges(edge, k, rounds):
    rows = usable(edge, lambda v: max(map(abs, v)) < 2 ** 19)
    assert sorted(repr(tuple(r)) for r in shallot.cluster(edge, k, rounds).collect()) == brute_clusters(rows, k, rounds)


def test_clusters_empty(spark):
    assert shallot.cluster(table(spark, [])).count() == 0
    assert shallot.cluster(table(spark, [(1, None)])).count() == 0
    assert shallot.cluster(table(spark, [(1, [0.25] * 64)])).count() == 1


def test_search_visits_fewer_centroids():
    """Bounds and the ball leave out most distances, and never the two nearest."""
    rng = np.random.default_rng(1)
    means = rng.integers(-4000, 4000, (30, 8))
    v = (means[rng.integers(0, 30, 3000)] + rng.integers(-40, 40, (3000, 8))).astype(np.int64)
    seen = []

    class Counting(shallot.Centroids):
        def squares(self, v, c):
            seen.append(len(v))
            return super().squares(v, c)

    centroids = Counting(means.astype(np.int64), np.zeros(30))
    a, b, da, db = shallot.search(v, centroids, np.zeros(3000, np.int64), np.ones(3000, np.int64))
    d = np.sort(((v[:, None] - means[None]) ** 2).sum(2), 1)
    assert (da == d[:, 0]).all() and (db == d[:, 1]).all() and sum(seen) < 3000 * 30
    seen.clear()
    again = shallot.search(v, centroids, a, b)
    assert (again[0] == a).all() and (again[1] == b).all() and sum(seen) < 3000 * 6


# --- 13

def brute_neighbours(rows, asked, k=10):
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i, _ in rows])
    out = []
    for q in (i for i, (name, _) in enumerate(rows) if name is not None and asked(name)):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((ids, d))[:min(k, len(rows) - 1)]
        out.append((rows[q][0], [(round(float(d[b]), 9), rows[b][0]) for b in best]))
    return out


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], round(r["score"], 9), r["vec_id"]))
    return {q: [x[1:] for x in sorted(v, key=lambda x: x[0])] for q, v in got.items()}


def recall(got, want):
    return np.mean([len({i for _, i in got[q]} & {i for _, i in near}) / len(near) for q, near in want])


def test_neighbours(spark, embeddings):
    want = brute_neighbours(usable(embeddings), lambda i: i % 100 == 0)
    got = found(queries.op13_neighbours(spark, SF))
    assert set(got) == {q for q, _ in want} and recall(got, want) >= 0.9
    assert all(len(got[q]) == 10 and len({i for _, i in got[q]}) == 10 for q in got)


def test_neighbours_recall_on_many_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_neighbours(usable(rows), lambda i: i % 50 == 0)
    got = found(forest.neighbours(rows, F.col("vec_id") % 50 == 0))
    assert recall(got, want) >= 0.9


@pytest.mark.parametrize("settings", [forest.Settings(), forest.Settings(rows=50, queries=7, leaf=8)], ids=["whole leaves", "dealt leaves"])
def test_neighbours_of_hot_copies(edge, settings):
    """Whole searches of a table a third of which is one vector: scores equal brute force where all trees are taken whole."""
    full = forest.Settings(**{**settings.__dict__, "recall": 1.0})
    rows = usable(edge, lambda v: any(v) and max(map(abs, v)) < 1e150)
    rows_of_id = {}
    for i, _ in rows:
        rows_of_id[i] = rows_of_id.get(i, 0) + 1
    want = [(q, near) for q, near in brute_neighbours(rows, lambda i: i % 7 == 0) if rows_of_id[q] == 1]
    got = found(forest.neighbours(edge, F.col("vec_id") % 7 == 0, settings=full))
    close = [[s for s, _ in got[q]] == [s for s, _ in near] for q, near in want]
    assert np.mean(close) > 0.95
    exact = [(q, near) for q, near in want if got[q] != near and [s for s, _ in got[q]] == [s for s, _ in near]]
    assert len(exact) <= 0.05 * len(want)


def test_neighbours_edges(spark):
    assert forest.neighbours(table(spark, []), F.lit(True)).count() == 0
    assert forest.neighbours(table(spark, [(1, None), (2, [0.0] * 4)]), F.lit(True)).count() == 0
    assert forest.neighbours(table(spark, [(1, [1.0, 0.0])]), F.lit(True)).count() == 0
    three = table(spark, [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (None, [1.0, 0.5]), (7, [2.0, 0.0]), (8, [1.0])])
    got = forest.neighbours(three, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [
        (100, 1, 100, 0.0), (100, 1, 100, 0.0), (100, 2, None, 0.5), (100, 2, None, 0.5), (100, 3, 7, 1.0), (100, 3, 7, 1.0)]


def test_forest_takes_near_leaves_first():
    x = np.random.default_rng(2).standard_normal((2000, 16))
    trees = forest.Forest([forest.grow(x, 20, np.random.default_rng(s)) for s in range(4)])
    counts = np.bincount(trees.leaves_of(x).ravel(), minlength=trees.first[-1])
    assert counts.sum() == 4 * len(x) and counts.max() <= 20
    for taken in trees.walk(x[:50], counts, np.inf):
        assert sorted(taken) == list(range(trees.first[-1]))
    own = trees.leaves_of(x[:50])
    assert all(set(o) == set(t[:4]) for o, t in zip(own.tolist(), trees.walk(x[:50], counts, np.inf)))
