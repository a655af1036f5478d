"""Registered queries: cubes, grid, cell graph, parts, halo."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpgrid.functions.expressions import r
from kelpgrid.operators import grid as G
from kelpgrid.operators import parts as P
from kelpgrid.plans.fixtures import ALPHA, CELL, EPS_S, EPS_T, ORACLE_POINTS, PARTS, points, table, unit_sql
from kelpgrid.plans.registry import query
from kelpgrid.sources import points as PT

CELLS = f"""WITH RECURSIVE {ORACLE_POINTS},
lim AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(t) t0, max(t) t1 FROM p),
c AS (SELECT p.*, CAST(floor((x-x0)/50.0) AS BIGINT) cx, CAST(floor((y-y0)/25.0) AS BIGINT) cy,
 CAST(floor((t-t0)/2000.0) AS BIGINT) ct FROM p, lim),
hist AS MATERIALIZED (SELECT row_number() OVER (ORDER BY cx, cy, ct) AS cell_id, cx, cy, ct, n
 FROM (SELECT cx, cy, ct, count(*) AS n FROM c GROUP BY ALL)),
cube AS (SELECT hist.*, lim.x0+cx*50.0 AS bx0, lim.x0+cx*50.0+50.0 AS bx1, lim.y0+cy*25.0 AS by0, lim.y0+cy*25.0+25.0 AS by1,
 lim.t0+ct*2000.0 AS bt0, lim.t0+ct*2000.0+2000.0 AS bt1 FROM hist, lim),
e AS MATERIALIZED (SELECT a.cell_id AS src, b.cell_id AS dst, sqrt(CAST(a.n AS DOUBLE)*b.n) AS w FROM hist a JOIN hist b
 ON a.cell_id < b.cell_id AND abs(a.cx-b.cx) <= 1 AND abs(a.cy-b.cy) <= 1 AND abs(a.ct-b.ct) <= 1),
rr AS (SELECT *, (cell_id-1) % 8 AS part FROM hist),
de AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e),
le AS (SELECT de.*, a.part AS sp, b.part AS dp FROM de JOIN rr a ON a.cell_id = src JOIN rr b ON b.cell_id = dst),
mg AS (SELECT o.src AS cell_id, o.sp AS part, o.dp AS target, o.w - coalesce(i.w, 0) AS gain
 FROM (SELECT src, sp, dp, sum(w) w FROM le WHERE sp <> dp GROUP BY ALL) o
 LEFT JOIN (SELECT src, sum(w) w FROM le WHERE sp = dp GROUP BY ALL) i ON i.src = o.src)
"""

MORTON = " | ".join(f"(((c{a} >> {i}) & 1) << {3 * i + j})" for i in range(20) for j, a in enumerate("xyt"))
PACKED = CELLS + f""", packed AS (SELECT cell_id, cx, cy, ct, n, CAST(floor(8 * (sum(n) OVER (ORDER BY z) - n)
 / sum(n) OVER ()) AS BIGINT) AS part FROM (SELECT *, {MORTON} AS z FROM hist)),
pcube AS (SELECT cube.*, packed.part FROM cube JOIN packed USING (cell_id))
"""


def histogram(spark, sf):
    pts = points(spark, sf)
    corner = G.bounding_cube(pts)
    return pts, corner, P.materialize(G.cell_histogram(G.grid_cells(pts, CELL, corner)))


def packed_cubes(spark, sf):
    pts, corner, hist = histogram(spark, sf)
    return pts, corner, P.materialize(G.cell_cubes(P.pack_cells(hist, PARTS), corner, CELL))


@query("sample_fraction", f"WITH {ORACLE_POINTS} SELECT id, x, y FROM p WHERE {unit_sql('CAST(id AS VARCHAR)', chr(39) + '9961' + chr(39))} < 0.1")
def sample_fraction(spark, sf):
    return G.sample_fraction(points(spark, sf).select("id", "x", "y"), 0.1)


@query("sample_n", f"""WITH {ORACLE_POINTS} SELECT id, x, y FROM p
ORDER BY md5(CAST(id AS VARCHAR) || ':9961'), id LIMIT 20000""")
def sample_n(spark, sf):
    return G.sample_n(points(spark, sf).select("id", "x", "y"), 20_000)


@query("bounding_cube", CELLS + "SELECT x0, x1, y0, y1, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM lim")
def bounding_cube(spark, sf):
    return G.bounding_cube(points(spark, sf)).withColumns({"t0": r("t0"), "t1": r("t1")})


def _middle(spark, sf, pts):
    """Cube of the middle half of the bounding cube on every axis."""
    lim = G.bounding_cube(pts)
    for a in G.AXES:
        q = (F.col(f"{a}1") - F.col(f"{a}0")) / 4
        lim = lim.withColumns({f"{a}0": F.col(f"{a}0") + q, f"{a}1": F.col(f"{a}1") - q})
    return lim


MIDDLE = CELLS + """, mid AS (SELECT x0+(x1-x0)/4 AS x0, x1-(x1-x0)/4 AS x1, y0+(y1-y0)/4 AS y0, y1-(y1-y0)/4 AS y1,
 t0+(t1-t0)/4 AS t0, t1-(t1-t0)/4 AS t1 FROM lim)
"""


@query("cube_contains_point", MIDDLE + """SELECT id FROM p, mid WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1
AND t BETWEEN t0 AND t1""")
def cube_contains_point(spark, sf):
    pts = points(spark, sf)
    return G.attach_row(pts, _middle(spark, sf, pts)).filter(G.cube_contains_point()).select("id")


@query("cube_almost_contains", MIDDLE + """SELECT id FROM p, mid WHERE x > x0 AND x < x1 AND y > y0 AND y < y1
AND t > t0 AND t < t1""")
def cube_almost_contains(spark, sf):
    pts = points(spark, sf)
    return G.attach_row(pts, _middle(spark, sf, pts)).filter(G.cube_almost_contains()).select("id")


@query("cube_contains_cube", MIDDLE + """SELECT cell_id FROM cube, mid WHERE bx0 >= x0 AND bx1 <= x1 AND by0 >= y0
AND by1 <= y1 AND bt0 >= t0 AND bt1 <= t1""")
def cube_contains_cube(spark, sf):
    pts, corner, hist = histogram(spark, sf)
    mid = _middle(spark, sf, pts)
    cubes = G.attach_row(G.cell_cubes(hist, corner, CELL), mid.select(*[F.col(c).alias(f"o_{c}") for c in mid.columns]))
    return cubes.filter(G.cube_contains_cube("o_", "")).select("cell_id")


@query("cube_shrink", CELLS + """SELECT cell_id, round(bx0+5.0, 6) x0, round(bx1-5.0, 6) x1, round(by0+5.0, 6) y0,
round(by1-5.0, 6) y1, round(bt0+300.0, 6) t0, round(bt1-300.0, 6) t1 FROM cube""")
def cube_shrink(spark, sf):
    _, corner, hist = histogram(spark, sf)
    inner = G.cube_shrink(G.cell_cubes(hist, corner, CELL), EPS_S, EPS_T)
    return inner.select("cell_id", *[r(f"{a}{e}").alias(f"{a}{e}") for a in G.AXES for e in "01"])


@query("grid_cells", CELLS + "SELECT id, cx, cy, ct FROM c")
def grid_cells(spark, sf):
    return G.grid_cells(points(spark, sf), CELL).select("id", "cx", "cy", "ct")


@query("cell_histogram", CELLS + "SELECT cell_id, cx, cy, ct, n FROM hist")
def cell_histogram(spark, sf):
    return histogram(spark, sf)[2]


@query("cell_adjacency", CELLS + "SELECT src, dst, round(w, 6) AS w FROM e")
def cell_adjacency(spark, sf):
    return G.cell_adjacency(histogram(spark, sf)[2]).withColumn("w", r("w"))


@query("isolated_cells", CELLS + """SELECT cell_id, cx, cy, ct, n FROM hist
WHERE NOT EXISTS (SELECT 1 FROM de WHERE de.src = hist.cell_id)""")
def isolated_cells(spark, sf):
    hist = histogram(spark, sf)[2]
    return G.isolated_cells(hist, G.cell_adjacency(hist))


@query("graph_totals", CELLS + """SELECT part, round(sum(CASE WHEN sp = dp THEN w ELSE 0 END), 4) AS internal,
(SELECT count(*) FROM hist) AS vertices, (SELECT round(sum(w), 4) FROM de) AS total,
(SELECT round(2 * sum(CASE WHEN sp = dp THEN w ELSE 0 END) - sum(w), 4) FROM le) AS cost
FROM (SELECT DISTINCT part FROM rr) r LEFT JOIN le ON le.sp = r.part GROUP BY part""")
def graph_totals(spark, sf):
    hist = histogram(spark, sf)[2]
    out = P.graph_totals(G.cell_adjacency(hist), P.round_robin_parts(hist, PARTS))
    return out.withColumns({c: r(c, 4) for c in ("internal", "total", "cost")})


@query("round_robin_parts", CELLS + "SELECT cell_id, part FROM rr")
def round_robin_parts(spark, sf):
    return P.round_robin_parts(histogram(spark, sf)[2], PARTS).select("cell_id", "part")


@query("part_loads", CELLS + """SELECT part, count(*) AS cells, CAST(sum(n) AS BIGINT) AS load,
CAST(max(sum(n)) OVER () AS BIGINT) AS max_part, CAST(min(sum(n)) OVER () AS BIGINT) AS min_part FROM rr GROUP BY part""")
def part_loads(spark, sf):
    loads = P.part_loads(P.round_robin_parts(histogram(spark, sf)[2], PARTS))
    return G.attach_row(loads, loads.agg(F.max("load").alias("max_part"), F.min("load").alias("min_part")))


@query("load_bounds", CELLS + """SELECT total, base, CAST(trunc(base * (1.0::DOUBLE + 0.2::DOUBLE)) AS BIGINT) AS max_load,
CAST(trunc(base * (1.0::DOUBLE - 0.2::DOUBLE)) AS BIGINT) AS min_load
FROM (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) // 8 AS base FROM hist)""")
def load_bounds(spark, sf):
    return P.load_bounds(histogram(spark, sf)[2], PARTS, ALPHA)


@query("move_gain", CELLS + "SELECT cell_id, part, target, round(gain, 6) + 0.0 AS gain FROM mg")
def move_gain(spark, sf):
    hist = histogram(spark, sf)[2]
    return P.move_gain(G.cell_adjacency(hist), P.round_robin_parts(hist, PARTS)).withColumn("gain", r("gain"))


@query("swap_gain", CELLS + """SELECT src, dst, round(a.gain + b.gain - 2 * w, 6) + 0.0 AS gain FROM le
JOIN mg a ON a.cell_id = src AND a.target = dp JOIN mg b ON b.cell_id = dst AND b.target = sp WHERE src < dst AND sp <> dp""")
def swap_gain(spark, sf):
    hist = histogram(spark, sf)[2]
    return P.swap_gain(G.cell_adjacency(hist), P.round_robin_parts(hist, PARTS)).withColumn("gain", r("gain"))


def _cap(hist):
    """Upper load bound as a number: one scalar decides when the rounds stop."""
    return P.load_bounds(hist, PARTS, ALPHA).first()["max_load"]


@query("refine_parts")
def refine_parts(spark, sf):
    hist = histogram(spark, sf)[2]
    out = P.refine_parts(G.cell_adjacency(hist), P.round_robin_parts(hist, PARTS), _cap(hist))
    return out.select("cell_id", "n", "part")


@query("merge_adjacent")
def merge_adjacent(spark, sf):
    hist = histogram(spark, sf)[2]
    return P.merge_adjacent(hist, G.cell_adjacency(hist), _cap(hist)).select("cell_id", "n", "part")


@query("seed_grow")
def seed_grow(spark, sf):
    hist = histogram(spark, sf)[2]
    return P.seed_grow(hist, G.cell_adjacency(hist), _cap(hist)).select("cell_id", "n", "part")


@query("split_parts", CELLS + """, bound AS (SELECT CAST(sum(n) AS BIGINT) // 8 AS max_load FROM hist),
st AS (SELECT part, count(*) AS cells, sum(n) AS load FROM rr GROUP BY part),
sz AS (SELECT part, CAST(ceil(cells / (CASE WHEN load >= max_load THEN ceil(load / max_load::DOUBLE) ELSE 1 END)) AS BIGINT) AS size
 FROM st, bound)
SELECT cell_id, part, CAST(floor((rn - 1) / size) AS BIGINT) AS chunk
FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY cell_id) AS rn FROM rr) JOIN sz USING (part)""")
def split_parts(spark, sf):
    hist = histogram(spark, sf)[2]
    bound = P.load_bounds(hist, PARTS, 0.0).select("max_load")
    return P.split_parts(P.round_robin_parts(hist, PARTS), bound).select("cell_id", "part", "chunk")


@query("merge_parts", CELLS + """, parts40 AS (SELECT (cell_id-1) % 40 AS part, CAST(sum(n) AS BIGINT) AS load FROM hist GROUP BY 1),
bound AS (SELECT CAST(sum(n) AS BIGINT) // 8 AS min_load FROM hist),
small AS (SELECT part, load, min_load, row_number() OVER (ORDER BY part) AS i FROM parts40, bound WHERE load <= min_load),
f(i, part, acc, grp) AS (SELECT i, part, CASE WHEN load >= min_load THEN 0 ELSE load END, CASE WHEN load >= min_load THEN 1 ELSE 0 END
  FROM small WHERE i = 1
 UNION ALL SELECT s.i, s.part, CASE WHEN f.acc + s.load >= s.min_load THEN 0 ELSE f.acc + s.load END,
  f.grp + CASE WHEN f.acc + s.load >= s.min_load THEN 1 ELSE 0 END FROM f JOIN small s ON s.i = f.i + 1)
SELECT q.part, q.load, CAST(CASE WHEN f.i = 1 THEN 0 ELSE lag(f.grp) OVER (ORDER BY f.i NULLS LAST) END AS BIGINT) AS merged
FROM parts40 q LEFT JOIN f USING (part)""")
def merge_parts(spark, sf):
    hist = histogram(spark, sf)[2]
    bound = P.load_bounds(hist, PARTS, 0.0).select("min_load")
    return P.merge_parts(P.part_loads(P.round_robin_parts(hist, 5 * PARTS)).select("part", "load"), bound)


@query("pack_cells", PACKED + "SELECT cell_id, part FROM packed")
def pack_cells(spark, sf):
    return P.pack_cells(histogram(spark, sf)[2], PARTS).select("cell_id", "part")


HALO = PACKED + """, near AS (SELECT pcube.part, p.id,
 CASE WHEN x > bx0+5 AND x < bx1-5 AND y > by0+5 AND y < by1-5 AND t > bt0+300 AND t < bt1-300 THEN 2
  WHEN x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1 AND t BETWEEN bt0 AND bt1 THEN 1 ELSE 0 END AS z
 FROM p JOIN pcube ON x BETWEEN bx0-5 AND bx1+5 AND y BETWEEN by0-5 AND by1+5 AND t BETWEEN bt0-300 AND bt1+300)
"""


@query("halo_assign", HALO + "SELECT DISTINCT id, part FROM near")
def halo_assign(spark, sf):
    pts, corner, cubes = packed_cubes(spark, sf)
    return P.halo_assign(pts, cubes, corner, CELL, EPS_S, EPS_T).select("id", "part")


@query("point_zone", HALO + """SELECT part, id, CASE max(z) WHEN 2 THEN 'inner' WHEN 1 THEN 'margin' ELSE 'halo' END AS zone
FROM near GROUP BY part, id""")
def point_zone(spark, sf):
    pts, corner, cubes = packed_cubes(spark, sf)
    return P.point_zone(pts, cubes, corner, CELL, EPS_S, EPS_T)


@query("list_inputs")
def list_inputs(spark, sf):
    return PT.list_inputs(table(spark, sf, "events"))
