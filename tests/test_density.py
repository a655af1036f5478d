"""Clustering against brute force, in both routes and with forced refinement."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kelpgrid.operators import density as D
from kelpgrid.operators import grid as G
from kelpgrid.operators import parts as P
from kelpgrid.operators.components import connected_components

COLS = "id long, x double, y double, t double"


def brute(pdf, es, et, mp):
    x, y, t, ids = (pdf[c].to_numpy() for c in ("x", "y", "t", "id"))
    near = ((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= es * es) & (np.abs(t[:, None] - t) <= et)
    core = near.sum(1) >= mp
    root = np.where(core, ids, -1)
    while True:
        new = root.copy()
        for i in np.flatnonzero(core):
            new[i] = root[near[i] & core].min()
        if (new == root).all():
            break
        root = new
    out = {}
    for i in range(len(ids)):
        if core[i]:
            out[ids[i]] = ("core", root[i])
        else:
            hit = root[near[i] & core]
            out[ids[i]] = ("border", hit.min()) if len(hit) else ("noise", None)
    number = {r: k + 1 for k, r in enumerate(sorted({r for _, r in out.values() if r is not None}))}
    return {i: (f, number.get(r, 0)) for i, (f, r) in out.items()}, near.sum(1)


def as_dict(df):
    return {r["id"]: (r["flag"], r["cluster"]) for r in df.collect()}


def cloud(n=220, seed=1):
    """Background, a hot cell of near copies, exact copies, a grid with points exactly one radius apart."""
    rng = np.random.default_rng(seed)
    a = rng.uniform(-10, 10, (n // 2, 3))
    hot = rng.normal(0, 0.3, (n // 3, 3)) + [2, 2, 0]
    same = np.repeat([[5.0, 5.0, 5.0]], 9, axis=0)
    line = np.array([[-9 + i, -9.0, 3.0] for i in range(12)])
    xyz = np.vstack([a, hot, same, line])
    return pd.DataFrame({"id": rng.permutation(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "t": xyz[:, 2]})


@pytest.mark.parametrize("es,et,mp", [(1.0, 1.0, 4), (1.0, 0.5, 1), (2.5, 3.0, 6), (0.0, 0.0, 3)])
def test_st_dbscan_equals_brute_force(spark, es, et, mp):
    pdf = cloud()
    want, _ = brute(pdf, es, et, mp)
    assert as_dict(D.st_dbscan(spark.createDataFrame(pdf, COLS), es, et, mp)) == want


def test_refined_boxes_give_the_same(spark):
    pdf = cloud(150, seed=4)
    df = spark.createDataFrame(pdf, COLS)
    want, counts = brute(pdf, 1.2, 1.0, 5)
    assert as_dict(D.st_dbscan(df, 1.2, 1.0, 5, budget=30)) == want
    got = {r["id"]: r["n"] for r in D.neighbor_counts(df, 1.2, 1.0, budget=30).collect()}
    assert got == dict(zip(pdf["id"], counts))


def test_neighbors_of(spark):
    pdf = cloud(100)
    df = spark.createDataFrame(pdf, COLS)
    _, counts = brute(pdf, 1.0, 1.0, 3)
    got = D.neighbors_of(df, df, 1.0, 1.0).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == dict(zip(pdf["id"], counts))


@pytest.mark.parametrize("k", [1, 5])
def test_partitioned_route_is_equal(spark, k):
    pdf = cloud(160, seed=2)
    df = spark.createDataFrame(pdf, COLS)
    cell, es, et, mp = (4.0, 4.0, 4.0), 1.2, 1.2, 4
    corner = G.bounding_cube(df)
    hist = G.cell_histogram(G.grid_cells(df, cell, corner))
    cubes = G.cell_cubes(P.pack_cells(hist, k), corner, cell)
    copies = P.halo_assign(df, cubes, corner, cell, es, et)
    assert as_dict(D.st_dbscan_partitioned(copies, es, et, mp)) == brute(pdf, es, et, mp)[0]


def test_edge_inputs(spark):
    empty = spark.createDataFrame([], COLS)
    assert D.st_dbscan(empty, 1.0, 1.0, 3).count() == 0
    one = spark.createDataFrame([(7, 0.0, 0.0, 0.0)], COLS)
    assert as_dict(D.st_dbscan(one, 1.0, 1.0, 2)) == {7: ("noise", 0)}
    chain = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(200)], COLS)
    assert set(as_dict(D.st_dbscan(chain, 1.0, 1.0, 2)).values()) == {("core", 1)}


@pytest.mark.parametrize("limit", [0, 10 ** 6])
def test_components(spark, limit):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [tuple(map(int, rng.integers(2000, 2060, 2))) for _ in range(40)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.createDataFrame([(n,) for n in [*parent, 5000]], "node long")
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), nodes, local_edges=limit)
    assert {r["node"]: r["root"] for r in got.collect()} == {**{n: find(n) for n in list(parent)}, 5000: 5000}


def test_parts_keep_all_cells_and_caps(spark):
    df = spark.createDataFrame(cloud(300, seed=8), COLS)
    hist = P.materialize(G.cell_histogram(G.grid_cells(df, (4.0, 4.0, 4.0))))
    edges = P.materialize(G.cell_adjacency(hist))
    n, total = hist.count(), hist.groupBy().sum("n").first()[0]
    cap = total // 4
    start = P.round_robin_parts(hist, 4)
    cost = lambda a: P.graph_totals(edges, a).first()["cost"]
    high = max(cap, P.part_loads(start).groupBy().max("load").first()[0])
    better = P.refine_parts(edges, start, high)
    assert better.count() == n and cost(better) >= cost(start)
    assert P.part_loads(better).groupBy().max("load").first()[0] <= high
    biggest = hist.groupBy().max("n").first()[0]
    merged = P.merge_adjacent(hist, edges, cap)
    assert merged.count() == n and P.part_loads(merged).groupBy().max("load").first()[0] <= max(cap, biggest)
    grown = P.seed_grow(hist, edges, cap)
    assert grown.count() == n and grown.select("cell_id").distinct().count() == n


def test_a_point_probes_at_most_eight_cells_and_meets_all_units_in_reach(spark):
    es, et = 2.0, 3.0
    df = spark.createDataFrame(cloud(200, seed=3), COLS)
    keyed = D.materialize(df.select("id", "x", "y", "t", *D._keys(0, es, et)))
    probes = D._cells_in_reach(D._coarse(keyed), es, et)
    assert probes.groupBy("id").count().agg({"count": "max"}).first()[0] <= 8
    got = {(r["id"], r["nx"], r["ny"], r["nt"]) for r in probes.collect()}
    rows = keyed.collect()
    near = [(a["id"], b["ux"] >> D.WIDE, b["uy"] >> D.WIDE, b["ut"] >> D.WIDE) for a in rows for b in rows
            if (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 <= es * es and abs(a["t"] - b["t"]) <= et]
    assert got.issuperset(near)


def refined_by_rounds(part, n, edges, cap):
    """Moves of one round: best part of every cell, no better mover beside it, by gain until the part is full."""
    part = dict(part)
    while True:
        best, load = {}, {}
        for c in part:
            load[part[c]] = load.get(part[c], 0) + n[c]
            to = {}
            for a, b, w in edges:
                if c in (a, b):
                    other = part[b if a == c else a]
                    to[other] = to.get(other, 0.0) + w
            gains = [(round(w - to.get(part[c], 0.0), 9), -p) for p, w in to.items() if p != part[c]]
            if gains and max(gains)[0] > 1e-9:
                best[c] = max(gains)
        beaten = {x for a, b, _ in edges if a in best and b in best for x, y in ((a, b), (b, a)) if (best[y][0], -y) > (best[x][0], -x)}
        moved, arriving = False, {}
        for c in sorted(set(best) - beaten, key=lambda c: (-best[c][0], c)):
            p = -best[c][1]
            arriving[p] = arriving.get(p, 0) + n[c]
            if load[p] + arriving[p] <= cap:
                part[c], moved = p, True
        if not moved:
            return part


def test_refine_parts_moves_as_by_rounds_and_labels_the_edges_once(spark, monkeypatch):
    df = spark.createDataFrame(cloud(120, seed=5), COLS)
    hist = P.materialize(G.cell_histogram(G.grid_cells(df, (4.0, 4.0, 4.0))))
    edges = P.materialize(G.cell_adjacency(hist))
    start = P.materialize(P.round_robin_parts(hist, 3))
    cap = int(hist.groupBy().sum("n").first()[0] // 3 * 1.3)
    rows = start.collect()
    want = refined_by_rounds({r["cell_id"]: r["part"] for r in rows}, {r["cell_id"]: r["n"] for r in rows}, [tuple(r) for r in edges.select("src", "dst", "w").collect()], cap)
    assert want != {r["cell_id"]: r["part"] for r in rows}
    calls, whole = [], P._labelled
    monkeypatch.setattr(P, "_labelled", lambda *a: calls.append(a) or whole(*a))
    got = P.refine_parts(edges, start, cap)
    assert got.columns == start.columns
    assert {r["cell_id"]: r["part"] for r in got.collect()} == want
    assert len(calls) == 1


@pytest.mark.parametrize("local, block", [(1_000_000, 500_000), (0, 150)])
def test_refine_parts_in_blocks_writes_one_table_a_round(spark, monkeypatch, local, block):
    """Blocks and the one task move as by rounds; a cell without a neighbour and one without a part stay."""
    df = spark.createDataFrame(pd.concat([cloud(120, seed=5), pd.DataFrame([(9000, 500.0, 500.0, 500.0)], columns=["id", "x", "y", "t"])]), COLS)
    hist = P.materialize(G.cell_histogram(G.grid_cells(df, (4.0, 4.0, 4.0))))
    edges = P.materialize(G.cell_adjacency(hist))
    start = P.materialize(P.round_robin_parts(hist, 3).withColumn("part", F.when(F.col("cell_id") != 7, F.col("part"))))
    cap = int(hist.groupBy().sum("n").first()[0] // 3 * 1.3)
    rows = [r for r in start.collect() if r["part"] is not None]
    kept = {r["cell_id"] for r in rows}
    links = [tuple(r) for r in edges.select("src", "dst", "w").collect() if r["src"] in kept and r["dst"] in kept]
    want = refined_by_rounds({r["cell_id"]: r["part"] for r in rows}, {r["cell_id"]: r["n"] for r in rows}, links, cap)
    written, real = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda d: written.append(d.columns) or real(d))
    got = P.refine_parts(edges, start, cap, local, block)
    assert {r["cell_id"]: r["part"] for r in got.collect()} == {**want, 7: None}
    rounds = [c for c in written if "new" in c]
    assert len(written) - len(rounds) <= 10
    if local:
        assert not rounds


def test_nine_digits_round_as_in_spark(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 200), rng.normal(0, 1e5, 400), rng.normal(0, 1e8, 100), [0.0, 0.5e-9, -1.5e-9, 0.1234567885, 1e17, 8e6 + 2.5e-9]])
    want = [r["y"] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").orderBy("i").select(F.round("x", 9).alias("y")).collect()]
    assert P._nine_digits(x).tolist() == want


def merged_by_rounds(n, edges, cap):
    """All groups name their best neighbour under the cap, mutual ones merge, until none is left."""
    part = {c: c for c in n}
    while True:
        size, w, best = {}, {}, {}
        for c, g in part.items():
            size[g] = size.get(g, 0) + n[c]
        for a, b, x in edges:
            a, b = part[a], part[b]
            if a != b:
                w[a, b] = w[b, a] = w.get((a, b), 0.0) + x
        for (a, b), x in w.items():
            if size[a] + size[b] <= cap:
                best[a] = max(best.get(a, ((-1.0,), 0)), ((round(x, 9), -min(a, b), -max(a, b)), b))
        into = {a: b for a, (_, b) in best.items() if b < a and best[b][1] == a}
        if not into:
            return part
        part = {c: into.get(g, g) for c, g in part.items()}


@pytest.mark.parametrize("limit", [25, 200_000])
def test_merge_adjacent_rounds(spark, limit):
    """Contracted graph, finished in one task below a limit: the same groups as all rounds over all cells."""
    df = spark.createDataFrame(cloud(300, seed=3), COLS)
    hist = P.materialize(G.cell_histogram(G.grid_cells(df, (4.0, 4.0, 4.0))))
    edges = P.materialize(G.cell_adjacency(hist))
    cap = hist.groupBy().sum("n").first()[0] // 4
    want = merged_by_rounds({r["cell_id"]: r["n"] for r in hist.collect()}, [tuple(r) for r in edges.collect()], cap)
    got = P.merge_adjacent(hist, edges, cap, local_edges=limit)
    assert {r["cell_id"]: r["part"] for r in got.collect()} == want


def test_merge_locally_many_graphs():
    """The one-task rounds against all rounds, on random graphs with ties and several caps."""
    rng = np.random.default_rng(1)
    for trial in range(60):
        k = int(rng.integers(2, 60))
        n = {c: int(rng.integers(1, 9)) for c in range(1, k + 1)}
        pairs = {tuple(sorted(map(int, rng.integers(1, k + 1, 2)))) for _ in range(4 * k)}
        edges = [(a, b, float(np.sqrt(n[a] * n[b])) if trial % 2 else float(rng.integers(1, 4))) for a, b in sorted(pairs) if a != b]
        cap = max(2, int(sum(n.values()) * rng.uniform(0.1, 1.1)))
        rows = [(a, b, w, n[a], n[b]) for a, b, w in edges if n[a] + n[b] <= cap]
        found = [t for t in P._merge_locally(cap)([pd.DataFrame(rows, columns=["src", "dst", "w", "sa", "sb"])])]
        into = dict(zip(found[0]["part"], found[0]["into"])) if found else {}

        def end(c):
            while c in into:
                c = into[c]
            return c
        assert {c: end(c) for c in n} == merged_by_rounds(n, edges, cap)


def test_merge_locally_with_heaps(monkeypatch):
    """Groups of more than three neighbours keep heaps: the same groups as by rounds."""
    monkeypatch.setattr(P, "SCANNED", 3)
    test_merge_locally_many_graphs()


def test_merge_adjacent_of_over_200_000_edges_writes_few_tables(spark, monkeypatch):
    """The rounds of a grid whose groups take one neighbour a round are not written one by one."""
    side = 230
    hist = spark.range(side * side).select((F.col("id") + 1).alias("cell_id"), F.floor(F.col("id") / side).alias("cx"), (F.col("id") % side).alias("cy"), F.lit(0).cast("long").alias("ct"),
                                           (1 + F.pmod(F.xxhash64("id"), F.lit(50))).alias("n"))
    hist = P.materialize(hist)
    edges = P.materialize(G.cell_adjacency(hist))
    assert edges.count() > 200_000
    cap = hist.groupBy().sum("n").first()[0] // 8
    written, real = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda d: written.append(d.columns) or (pytest.fail("a table for each round") if len(written) > 4 else real(d)))
    got = P.merge_adjacent(hist, edges, cap)
    assert got.count() == side * side and P.part_loads(got).groupBy().max("load").first()[0] <= cap
