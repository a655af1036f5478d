"""ST-DBSCAN: density clustering with a spatial and a temporal radius.

Points are grouped into *units*: sub-cells small enough that all points of one
unit are neighbours of each other.  A unit with at least ``min_points`` points
is *dense*: its points are core points of one cluster without any distance test,
however many there are, and it takes part in everything else as a single node.
The remaining points are few per unit, so testing them against the units around
them is linear in the table.

Units are joined on coarse cells (an equi join over the 27 cells around a
point; a coarse cell holds at most 8 units).  The bounding box of a unit tells
whether it lies wholly inside or outside a ball; only boxes on the boundary are
opened, and boxes with many points are first cut finer (``_refine``), so a hot
cell never becomes an all-pairs test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions.ordering import long_table, with_row_number
from kelpgrid.operators.components import connected_components
from kelpgrid.session import materialize

# Relative slack between a cell edge and the radius; covers rounding of x / edge.
SLACK = 1e-6
# Boxes are cut finer while their points outnumber the pairs' share of this budget.
PAIR_BUDGET = 50_000_000
MAX_LEVEL = 40
# Points probe cells of 4 x 4 x 4 units: larger cells are fewer probes, each of which meets more boxes.
WIDE = 2


def squared_distance(a: str, b: str) -> Column:
    dx, dy = F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y")
    return dx * dx + dy * dy


def time_gap(a: str, b: str) -> Column:
    return F.abs(F.col(f"{a}t") - F.col(f"{b}t"))


def _edges(eps_s: float, eps_t: float) -> tuple[float, float]:
    """Edge of a unit in space and time (half the edge of a coarse cell)."""
    s = (eps_s if eps_s > 0 else 1e-6) / 2 ** 0.5 * (1 - SLACK)
    t = (eps_t if eps_t > 0 else 1e-6) * 0.75
    return s, t


def _keys(level: int, eps_s: float, eps_t: float, prefix: str = "u") -> list[Column]:
    s, t = _edges(eps_s, eps_t)
    f = 2.0 ** level
    return [F.floor(F.col("x") / F.lit(s / f)).alias(f"{prefix}x"), F.floor(F.col("y") / F.lit(s / f)).alias(f"{prefix}y"),
            F.floor(F.col("t") / F.lit(t / f)).alias(f"{prefix}t")]


UNIT = ["ux", "uy", "ut"]


def _box() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
            F.max("y").alias("y1"), F.min("t").alias("t0"), F.max("t").alias("t1")]


def _coarse(df: DataFrame) -> DataFrame:
    return df.withColumns({"cx": F.shiftright("ux", 1), "cy": F.shiftright("uy", 1), "ct": F.shiftright("ut", 1)})


def _cells_in_reach(df: DataFrame, eps_s: float, eps_t: float) -> DataFrame:
    """Repeat each point for the wide cells that its ball can meet (as key nx, ny, nt), at most 8."""
    s, t = _edges(eps_s, eps_t)
    out = df
    for axis, edge, reach in (("x", s, eps_s), ("y", s, eps_s), ("t", t, eps_t)):
        slack = F.lit(SLACK) * (F.lit(reach) + F.abs(F.col(axis)) * F.lit(1e-6))
        low, high = (F.floor((F.col(axis) + sign * (F.lit(reach) + slack)) / F.lit(edge * 2 ** WIDE)) for sign in (-1, 1))
        at = F.shiftright(f"u{axis}", WIDE)
        out = out.select("*", F.explode(F.sequence(at - F.when(low < at, 1).otherwise(0), at + F.when(high > at, 1).otherwise(0))).alias(f"n{axis}"))
    return out


def _around(df: DataFrame) -> DataFrame:
    """Repeat each row for the 27 coarse cells around it (as key nx, ny, nt)."""
    out = df
    for axis in "xyt":
        cell = F.col(f"c{axis}")
        out = out.select("*", F.explode(F.array(cell - 1, cell, cell + 1)).alias(f"n{axis}"))
    return out


def units(points: DataFrame, eps_s: float, eps_t: float, min_points: int, by: list[str] = ()) -> DataFrame:
    """Sub-cells with count, bounding box, smallest id and the ``dense`` flag."""
    by = list(by)
    keyed = points.select(*by, "id", "x", "y", "t", *_keys(0, eps_s, eps_t))
    u = keyed.groupBy(*by, *UNIT).agg(*_box(), F.min("id").alias("first_id"))
    wx, wy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    tight = (wx * wx + wy * wy <= eps_s * eps_s) & (F.col("t1") - F.col("t0") <= eps_t)
    return _coarse(u.withColumn("dense", tight & (F.col("n") >= min_points)))


def _gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> tuple[Column, Column]:
    """Smallest and largest coordinate difference between two intervals."""
    near = F.greatest(F.lit(0.0), lo_b - hi_a, lo_a - hi_b)
    far = F.greatest(hi_b - lo_a, hi_a - lo_b)
    return near, far


def _box_tests(a: str, b: str, eps_s: float, eps_t: float, point_a: bool) -> tuple[Column, Column]:
    """(may contain a pair within the radii, all pairs within the radii)."""
    def side(p, axis, end, is_point):
        return F.col(f"{p}{axis}") if is_point else F.col(f"{p}{axis}{end}")
    near, far = {}, {}
    for ax in "xyt":
        near[ax], far[ax] = _gap(side(a, ax, 0, point_a), side(a, ax, 1, point_a), side(b, ax, 0, False), side(b, ax, 1, False))
    e2 = eps_s * eps_s
    may = (near["x"] * near["x"] + near["y"] * near["y"] <= e2) & (near["t"] <= eps_t)
    whole = (far["x"] * far["x"] + far["y"] * far["y"] <= e2) & (far["t"] <= eps_t)
    return may, whole


def _prefixed(df: DataFrame, prefix: str, keep: list[str] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else f"{prefix}{c}") for c in df.columns])


def _child_boxes(points: DataFrame, level: int, eps_s: float, eps_t: float, by: list[str]) -> DataFrame:
    """Boxes of one level below, keyed by unit, parent box (px..) and own key (kx..)."""
    keyed = points.select(*by, *UNIT, "x", "y", "t", *_keys(level - 1, eps_s, eps_t, "p"), *_keys(level, eps_s, eps_t, "k"))
    return keyed.groupBy(*by, *UNIT, "px", "py", "pt", "kx", "ky", "kt").agg(*_box())


def ball_counts(queries: DataFrame, points: DataFrame, unit_table: DataFrame, eps_s: float, eps_t: float,
                by: list[str] = (), per_node: bool = True, budget: int = PAIR_BUDGET) -> DataFrame:
    """Neighbours of every query point: ``(*by, id, node, n)``.

    ``points`` carry ``node`` (their own id, or the first id of their dense
    unit) and their unit key; ``n`` counts the neighbours that belong to the
    node.  With ``per_node=False`` the result is the total ``(*by, id, n)``.
    Both radii are closed and a point is its own neighbour.
    """
    by = list(by)
    # Every row becomes several probes: spread the rows evenly first (by id, so hot cells do not matter).
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = queries.select(*by, "id", "x", "y", "t", *UNIT).repartition(parts, "id")
    q = _cells_in_reach(even, eps_s, eps_t).select(
        *by, *[F.col(c).alias(f"q_{c}") for c in ("id", "x", "y", "t")], "nx", "ny", "nt")
    box = _prefixed(unit_table, "b_", keep=by)
    box = box.withColumns({f"b_w{a}": F.shiftright(f"b_u{a}", WIDE) for a in "xyt"})
    cand = q.join(long_table(box), [q[c] == box[c] for c in by] + [q[f"n{a}"] == box[f"b_w{a}"] for a in "xyt"])
    for c in by:
        cand = cand.drop(box[c])
    may, whole = _box_tests("q_", "b_", eps_s, eps_t, point_a=True)
    cand = cand.filter(may).withColumn("whole", whole)
    as_node = F.col("whole") & ((F.col("b_n") == 1) | F.col("b_dense")) if per_node else F.col("whole")
    # Read three times below; the written table is about as long as the result.
    cand = materialize(cand.withColumn("settled", as_node).select(
        *by, "q_id", "q_x", "q_y", "q_t", *[f"b_{k}" for k in UNIT], "b_n", "b_first_id", "b_dense", "settled"))
    open_points = cand.agg(F.coalesce(F.sum(F.when(~F.col("settled"), F.col("b_n"))), F.lit(0))).first()[0]
    cols = [*by, F.col("q_id").alias("id"), F.col("b_first_id").alias("node"), F.col("b_n").alias("n")]
    done = cand.filter("settled").select(*cols)
    rest = cand.filter(~F.col("settled"))
    box_key = [f"b_{k}" for k in UNIT]
    if open_points:
        level = 0
        pts = points.select(*by, "id", "node", "x", "y", "t", *UNIT)
        if open_points > budget:
            done, rest, level = _refine_balls(done, rest, pts, eps_s, eps_t, by, per_node, budget)
        sub = "k" if level else None
        tested = _open_boxes(rest, pts, eps_s, eps_t, by, box_key, level, sub)
        done = done.unionByName(tested)
    group = [*by, "id", "node"] if per_node else [*by, "id"]
    return done.groupBy(*group).agg(F.sum("n").alias("n"))


def _open_boxes(rest, pts, eps_s, eps_t, by, box_key, level, sub):
    """Exact distance tests of query points against the points of the open boxes."""
    inner = pts
    on_box, on_pts = list(box_key), list(UNIT)
    if sub:
        inner = inner.select("*", *_keys(level, eps_s, eps_t, "k"))
        on_box += ["b_kx", "b_ky", "b_kt"]
        on_pts += ["kx", "ky", "kt"]
    right = inner.select(*[F.col(c).alias(f"p_{c}") for c in (*by, *on_pts, "id", "node", "x", "y", "t")])
    cond = [rest[c] == right[f"p_{c}"] for c in by] + [rest[a] == right[f"p_{b}"] for a, b in zip(on_box, on_pts)]
    hit = rest.join(long_table(right), cond).filter((squared_distance("q_", "p_") <= eps_s * eps_s) & (time_gap("q_", "p_") <= eps_t))
    return hit.select(*by, F.col("q_id").alias("id"), F.col("p_node").alias("node"), F.lit(1).cast("long").alias("n"))


def _refine_balls(done, rest, pts, eps_s, eps_t, by, per_node, budget):
    """Cut open boxes into eight until the points left to test fit the budget."""
    for level in range(1, MAX_LEVEL):
        kids = _child_boxes(pts.join(rest.select(*by, *[F.col(f"b_{k}").alias(k) for k in UNIT]).distinct(), [*by, *UNIT], "left_semi"),
                            level, eps_s, eps_t, by)
        kid = _prefixed(kids, "d_", keep=by)
        cond = [rest[c] == kid[c] for c in by] + [rest[f"b_{k}"] == kid[f"d_{k}"] for k in UNIT]
        if level > 1:
            cond += [rest[f"b_k{a}"] == kid[f"d_p{a}"] for a in "xyt"]
        step = rest.join(long_table(kid), cond)
        for c in by:
            step = step.drop(kid[c])
        may, whole = _box_tests("q_", "d_", eps_s, eps_t, point_a=True)
        step = step.filter(may).withColumn("inside", whole)
        step = step.select(*by, "q_id", "q_x", "q_y", "q_t", "b_first_id", "b_dense", *[f"b_{k}" for k in UNIT],
                           *[F.col(f"d_k{a}").alias(f"b_k{a}") for a in "xyt"], F.col("d_n").alias("b_n"), "inside")
        ok = F.col("inside") & (F.col("b_dense") if per_node else F.lit(True))
        step = materialize(step.withColumn("settled", ok))
        done = done.unionByName(step.filter("settled").select(
            *by, F.col("q_id").alias("id"), F.col("b_first_id").alias("node"), F.col("b_n").alias("n")))
        rest = step.filter(~F.col("settled"))
        left = rest.agg(F.coalesce(F.sum("b_n"), F.lit(0)), F.coalesce(F.max("b_n"), F.lit(0))).first()
        if left[0] <= budget or left[1] <= 1:
            break
    return done, rest, level


def dense_links(points: DataFrame, unit_table: DataFrame, eps_s: float, eps_t: float,
                by: list[str] = (), budget: int = PAIR_BUDGET) -> DataFrame:
    """Pairs of dense units that hold at least one neighbouring pair of points."""
    by = list(by)
    d = unit_table.filter("dense").select(*by, *UNIT, "first_id", "n", "x0", "x1", "y0", "y1", "t0", "t1", "cx", "cy", "ct")
    a = _around(d).drop("cx", "cy", "ct")
    a = a.select(*by, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in (*by, "nx", "ny", "nt")], "nx", "ny", "nt")
    b = _prefixed(d, "b_", keep=by)
    cond = [a[c] == b[c] for c in by] + [a[f"n{x}"] == b[f"b_c{x}"] for x in "xyt"] + [a["a_first_id"] < b["b_first_id"]]
    pairs = a.join(long_table(b), cond)
    for c in by:
        pairs = pairs.drop(b[c])
    may, whole = _box_tests("a_", "b_", eps_s, eps_t, point_a=False)
    pairs = materialize(pairs.filter(may).withColumn("whole", whole))
    ends = [*by, F.col("a_first_id").alias("src"), F.col("b_first_id").alias("dst")]
    found = pairs.filter("whole").select(*ends)
    rest = pairs.filter("not whole").drop("whole")
    work = rest.agg(F.coalesce(F.sum(F.col("a_n").cast("double") * F.col("b_n")), F.lit(0.0))).first()[0]
    if not work:
        return found
    pts = points.select(*by, *UNIT, "x", "y", "t")
    level = 0
    for level in range(1, MAX_LEVEL):
        if work <= budget:
            level -= 1
            break
        touched = rest.select(*by, *[F.col(f"a_{k}").alias(k) for k in UNIT]).unionByName(
            rest.select(*by, *[F.col(f"b_{k}").alias(k) for k in UNIT])).distinct()
        kids = materialize(_child_boxes(pts.join(touched, [*by, *UNIT], "left_semi"), level, eps_s, eps_t, by))
        step = rest.select(*by, "a_first_id", "b_first_id", *[f"{s}_{k}" for s in "ab" for k in UNIT],
                           *([f"{s}_k{x}" for s in "ab" for x in "xyt"] if level > 1 else []))
        for s in "ab":
            kid = kids.select(*[F.col(c).alias(f"{s}k_{c}") for c in kids.columns])
            cond = [step[c] == kid[f"{s}k_{c}"] for c in by] + [step[f"{s}_{k}"] == kid[f"{s}k_{k}"] for k in UNIT]
            if level > 1:
                cond += [step[f"{s}_k{x}"] == kid[f"{s}k_p{x}"] for x in "xyt"]
            step = step.join(long_table(kid), cond)
        may, whole = _box_tests("ak_", "bk_", eps_s, eps_t, point_a=False)
        step = step.filter(may).withColumn("whole", whole)
        step = materialize(step.select(
            *by, "a_first_id", "b_first_id", *[f"{s}_{k}" for s in "ab" for k in UNIT],
            *[F.col(f"{s}k_k{x}").alias(f"{s}_k{x}") for s in "ab" for x in "xyt"],
            F.col("ak_n").alias("a_n"), F.col("bk_n").alias("b_n"), "whole"))
        hit = step.filter("whole").select(*by, "a_first_id", "b_first_id").distinct()
        found = found.unionByName(hit.select(*ends))
        rest = step.filter("not whole").drop("whole").join(hit, [*by, "a_first_id", "b_first_id"], "left_anti")
        work = rest.agg(F.coalesce(F.sum(F.col("a_n").cast("double") * F.col("b_n")), F.lit(0.0))).first()[0]
        if not work:
            return found
    sub = level > 0
    inner = pts.select("*", *_keys(level, eps_s, eps_t, "k")) if sub else pts
    keys = UNIT + (["kx", "ky", "kt"] if sub else [])
    hit = rest.select(*by, "a_first_id", "b_first_id", *[f"{s}_{k}" for s in "ab" for k in keys])
    for s in "ab":
        side = inner.select(*[F.col(c).alias(f"{s}p_{c}") for c in (*by, *keys, "x", "y", "t")])
        hit = hit.join(long_table(side), [hit[c] == side[f"{s}p_{c}"] for c in by] + [hit[f"{s}_{k}"] == side[f"{s}p_{k}"] for k in keys])
    hit = hit.filter((squared_distance("ap_", "bp_") <= eps_s * eps_s) & (time_gap("ap_", "bp_") <= eps_t))
    return found.unionByName(hit.select(*ends).distinct())


class Neighborhood:
    """Shared intermediate tables of one clustering run.

    ``members``: every point with unit key, ``dense`` and ``node``.
    ``links``: neighbour counts of the points outside dense units, per node.
    Both are materialized once, because core test, edges and border points all
    read them.
    """

    def __init__(self, points: DataFrame, eps_s: float, eps_t: float, min_points: int, by: list[str] = (),
                 budget: int = PAIR_BUDGET):
        self.by, self.eps_s, self.eps_t, self.min_points, self.budget = list(by), eps_s, eps_t, min_points, budget
        by = self.by
        self.units = materialize(units(points, eps_s, eps_t, min_points, by))
        keyed = points.select(*by, "id", "x", "y", "t", *_keys(0, eps_s, eps_t))
        dense = self.units.filter("dense").select(*by, *UNIT, F.col("first_id").alias("unit_node"))
        self.members = materialize(
            keyed.join(long_table(dense), [*by, *UNIT], "left").withColumn("dense", F.col("unit_node").isNotNull())
            .withColumn("node", F.coalesce("unit_node", "id")).drop("unit_node"))
        self.links = materialize(ball_counts(self.members.filter("not dense"), self.members, self.units, eps_s, eps_t, by,
                                             budget=budget))

    def sparse_counts(self) -> DataFrame:
        return self.links.groupBy(*self.by, "id").agg(F.sum("n").alias("n"))

    def core_nodes(self) -> DataFrame:
        """Nodes made of core points: dense units and single core points."""
        alone = self.sparse_counts().filter(F.col("n") >= self.min_points).select(*self.by, F.col("id").alias("node"))
        return self.units.filter("dense").select(*self.by, F.col("first_id").alias("node")).unionByName(alone)

    def core_edges(self) -> DataFrame:
        core = self.core_nodes()
        by = self.by
        near = self.links.select(*by, F.col("id").alias("src"), F.col("node").alias("dst")).filter("src <> dst")
        near = near.join(core.withColumnRenamed("node", "src"), [*by, "src"], "left_semi")
        near = near.join(core.withColumnRenamed("node", "dst"), [*by, "dst"], "left_semi")
        return near.unionByName(dense_links(self.members, self.units, self.eps_s, self.eps_t, by, self.budget))


def neighbor_counts(points: DataFrame, eps_s: float, eps_t: float, budget: int = PAIR_BUDGET) -> DataFrame:
    """Exact neighbourhood size of every point, the point itself included."""
    u = materialize(units(points, eps_s, eps_t, 1))
    keyed = points.select("id", "x", "y", "t", *_keys(0, eps_s, eps_t)).withColumn("node", F.col("id"))
    return ball_counts(keyed, keyed, u, eps_s, eps_t, per_node=False, budget=budget)


def neighbors_of(queries: DataFrame, points: DataFrame, eps_s: float, eps_t: float) -> DataFrame:
    """All neighbours of the given query points: ``(id, neighbor)``.

    A lookup for chosen points; the output has one row per neighbouring pair.
    Clustering never lists pairs, it uses ``Neighborhood``.
    """
    a = _around(_coarse(queries.select("id", "x", "y", "t", *_keys(0, eps_s, eps_t)))).select(
        *[F.col(c).alias(f"q_{c}") for c in ("id", "x", "y", "t")], "nx", "ny", "nt")
    b = _coarse(points.select("id", "x", "y", "t", *_keys(0, eps_s, eps_t))).select(
        *[F.col(c).alias(f"p_{c}") for c in ("id", "x", "y", "t", "cx", "cy", "ct")])
    hit = a.join(long_table(b), [a[f"n{x}"] == b[f"p_c{x}"] for x in "xyt"])
    hit = hit.filter((squared_distance("q_", "p_") <= eps_s * eps_s) & (time_gap("q_", "p_") <= eps_t))
    return hit.select(F.col("q_id").alias("id"), F.col("p_id").alias("neighbor"))


def labels(hood: Neighborhood) -> DataFrame:
    """``(*by, id, flag, root)``; root is the smallest core id of the cluster."""
    by = hood.by
    core, edges = materialize(hood.core_nodes()), hood.core_edges()
    if by:
        def pack(c, name):
            return F.struct(*by, F.col(c).alias("node")).alias(name)
        comp = connected_components(edges.select(pack("src", "src"), pack("dst", "dst")), core.select(pack("node", "node")))
        comp = comp.select(*[F.col(f"node.{k}").alias(k) for k in by], F.col("node.node").alias("node"), F.col("root.node").alias("root"))
    else:
        comp = connected_components(edges, core)
    comp = materialize(comp)
    m = hood.members.select(*by, "id", "node")
    cores = m.join(comp, [*by, "node"]).select(*by, "id", F.lit("core").alias("flag"), "root")
    others = hood.members.filter("not dense").select(*by, "id").join(
        core.select(*by, F.col("node").alias("id")), [*by, "id"], "left_anti")
    reach = (hood.links.join(comp, [*by, "node"]).groupBy(*by, "id").agg(F.min("root").alias("root")))
    rest = others.join(reach, [*by, "id"], "left").select(
        *by, "id", F.when(F.col("root").isNotNull(), "border").otherwise("noise").alias("flag"), "root")
    return cores.unionByName(rest)


def number_clusters(labeled: DataFrame) -> DataFrame:
    """Replace ``root`` by dense cluster numbers from 1 (0 = noise)."""
    roots = labeled.filter("root is not null").select("root").distinct()
    numbered = with_row_number(roots, [], ["root"], "cluster")
    return labeled.join(numbered, "root", "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))


def st_dbscan(points: DataFrame, eps_s: float, eps_t: float, min_points: int, budget: int = PAIR_BUDGET) -> DataFrame:
    """``points(id, x, y, t)`` -> ``(id, flag, cluster)``; cluster 0 is noise."""
    hood = Neighborhood(points, eps_s, eps_t, min_points, budget=budget)
    labeled = materialize(labels(hood))
    return number_clusters(labeled).select("id", "flag", "cluster")


def local_clusters(copies: DataFrame, eps_s: float, eps_t: float, min_points: int, budget: int = PAIR_BUDGET) -> tuple[DataFrame, DataFrame]:
    """Cluster every part on its own.

    Returns the labels ``(part, id, flag, root)`` and the contacts ``(part, id,
    root)``: all local clusters that a copy belongs to or touches.
    """
    hood = Neighborhood(copies, eps_s, eps_t, min_points, by=["part"], budget=budget)
    labeled = materialize(labels(hood))
    roots = labeled.filter("flag = 'core'").select("part", F.col("id").alias("node"), "root")
    touch = hood.links.join(roots, ["part", "node"]).select("part", "id", "root")
    own = labeled.filter("root is not null").select("part", "id", "root")
    return labeled, materialize(own.unionByName(touch).distinct())


def merge_edges(labeled: DataFrame, contacts: DataFrame) -> DataFrame:
    """Links between local clusters through points that are core in some part.

    Per point the clusters are tied to the first of them, not to each other.
    """
    core = labeled.filter("flag = 'core'").select("id").distinct()
    node = contacts.join(core, "id", "left_semi").select("id", F.struct("part", "root").alias("node"))
    first = node.groupBy("id").agg(F.min("node").alias("first"))
    return (node.join(first, "id").filter("node <> first")
            .select(F.col("node").alias("src"), F.col("first").alias("dst")).distinct())


def global_cluster_ids(labeled: DataFrame, edges: DataFrame) -> DataFrame:
    """``(part, root, global_root, cluster)``: linked local clusters share a number from 1."""
    local = labeled.filter("root is not null").select(F.struct("part", "root").alias("node"))
    comp = connected_components(edges, local)
    flat = comp.select(F.col("node.part").alias("part"), F.col("node.root").alias("root"), F.col("root").alias("rep"))
    least = flat.groupBy("rep").agg(F.min("root").alias("global_root"))
    named = materialize(flat.join(least, "rep").select("part", "root", "global_root"))
    numbers = with_row_number(named.select("global_root").distinct(), [], ["global_root"], "cluster")
    return materialize(named.join(numbers, "global_root"))


def resolve_labels(labeled: DataFrame, contacts: DataFrame, ids: DataFrame) -> DataFrame:
    """Strongest label over the copies of a point: core > border > noise."""
    strength = F.when(F.col("flag") == "core", 2).when(F.col("flag") == "border", 1).otherwise(0)
    best = labeled.groupBy("id").agg(F.max(strength).alias("s"))
    seen = contacts.join(ids, ["part", "root"]).groupBy("id").agg(F.min("cluster").alias("cluster"))
    return best.join(seen, "id", "left").select(
        "id", F.when(F.col("s") == 2, "core").when(F.col("s") == 1, "border").otherwise("noise").alias("flag"),
        F.coalesce("cluster", F.lit(0)).alias("cluster"))


def st_dbscan_partitioned(copies: DataFrame, eps_s: float, eps_t: float, min_points: int, budget: int = PAIR_BUDGET) -> DataFrame:
    """Same result as ``st_dbscan`` by way of halo copies, local clusters and a merge."""
    labeled, contacts = local_clusters(copies, eps_s, eps_t, min_points, budget)
    ids = global_cluster_ids(labeled, merge_edges(labeled, contacts))
    return resolve_labels(labeled, contacts, ids)
