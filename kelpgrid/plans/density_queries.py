"""Registered queries: density clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpgrid.functions.expressions import r
from kelpgrid.functions.ordering import with_previous
from kelpgrid.operators import density as D
from kelpgrid.operators import grid as G
from kelpgrid.operators import parts as P
from kelpgrid.operators.components import connected_components, reachable
from kelpgrid.plans.fixtures import CELL, EPS_S, EPS_T, MIN_POINTS, ORACLE_POINTS, points
from kelpgrid.plans.grid_queries import CELLS, HALO, histogram, packed_cubes
from kelpgrid.plans.registry import query

NB = f"""WITH RECURSIVE {ORACLE_POINTS},
nb AS MATERIALIZED (SELECT a.id ia, b.id ib FROM p a JOIN p b
 ON b.t BETWEEN a.t-300 AND a.t+300 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 25),
cnt AS MATERIALIZED (SELECT ia, count(*) AS n FROM nb GROUP BY 1),
core AS MATERIALIZED (SELECT ia FROM cnt WHERE n >= 5),
e AS MATERIALIZED (SELECT nb.ia, nb.ib FROM nb JOIN core c1 ON nb.ia=c1.ia JOIN core c2 ON nb.ib=c2.ia),
cc(node, root) AS (SELECT ia, ia FROM core UNION
 SELECT e.ib, cc.root FROM cc JOIN e ON e.ia = cc.node AND e.ib > cc.root),
lab AS (SELECT node, min(root) root FROM cc GROUP BY 1),
near AS (SELECT nb.ia id, min(l.root) root FROM nb JOIN lab l ON nb.ib = l.node GROUP BY 1),
allp AS (SELECT p.id, coalesce(lab.root, near.root) root,
 CASE WHEN lab.root IS NOT NULL THEN 'core' WHEN near.root IS NOT NULL THEN 'border' ELSE 'noise' END flag
 FROM p LEFT JOIN lab ON lab.node = p.id LEFT JOIN near ON near.id = p.id)
"""

ST_DBSCAN_SQL = NB + """SELECT id, flag, CASE WHEN root IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY root NULLS LAST) END AS cluster
FROM allp"""


@query("st_dbscan", ST_DBSCAN_SQL)
def st_dbscan(spark, sf):
    return D.st_dbscan(points(spark, sf), EPS_S, EPS_T, MIN_POINTS)


@query("neighbor_count", NB + "SELECT ia AS id, n AS neighbors FROM cnt")
def neighbor_count(spark, sf):
    return D.neighbor_counts(points(spark, sf), EPS_S, EPS_T).select("id", F.col("n").alias("neighbors"))


@query("spatial_distance", f"""WITH {ORACLE_POINTS} SELECT id, round(dx*dx+dy*dy, 6) AS d2, round(abs(dt), 6) AS dt FROM (
SELECT id, lag(x) OVER w - x AS dx, lag(y) OVER w - y AS dy, lag(t) OVER w - t AS dt FROM p WINDOW w AS (ORDER BY id))""")
def spatial_distance(spark, sf):
    pair = with_previous(points(spark, sf), [], ["id"], {"px": "x", "py": "y", "pt": "t"})
    pair = pair.withColumns({f"q{a}": F.col(a) for a in "xyt"})
    return pair.select("id", r(D.squared_distance("p", "q")).alias("d2"), r(D.time_gap("p", "q")).alias("dt"))


# Edges of a unit, as the library computes them for radii 5 and 300.
UNIT_SQL = NB + f""", unit AS (SELECT id, x, y, t, floor(x/{D._edges(5.0, 300.0)[0]!r}) ux, floor(y/{D._edges(5.0, 300.0)[0]!r}) uy,
 floor(t/225.0) ut FROM p),
dn AS (SELECT ux, uy, ut, min(id) AS rep FROM unit GROUP BY ALL HAVING count(*) >= 5
 AND (max(x)-min(x))*(max(x)-min(x))+(max(y)-min(y))*(max(y)-min(y)) <= 25 AND max(t)-min(t) <= 300),
mem AS (SELECT id, dn.rep, coalesce(dn.rep, id) AS node FROM unit LEFT JOIN dn USING (ux, uy, ut))
"""


@query("eps_join", UNIT_SQL + """SELECT nb.ia AS id, m.node, count(*) AS n FROM nb JOIN mem m ON m.id = nb.ib
JOIN mem q ON q.id = nb.ia WHERE q.rep IS NULL GROUP BY ALL""")
def eps_join(spark, sf):
    """Neighbourhoods of all points outside dense units; a dense unit is one node with a count."""
    return D.Neighborhood(points(spark, sf), EPS_S, EPS_T, MIN_POINTS).links


@query("core_points", NB + "SELECT ia AS id FROM core")
def core_points(spark, sf):
    hood = D.Neighborhood(points(spark, sf), EPS_S, EPS_T, MIN_POINTS)
    return hood.members.join(hood.core_nodes(), "node", "left_semi").select("id")


@query("point_flags", NB + "SELECT id, flag FROM allp")
def point_flags(spark, sf):
    return D.labels(D.Neighborhood(points(spark, sf), EPS_S, EPS_T, MIN_POINTS)).select("id", "flag")


@query("core_components", NB + "SELECT node AS id, root FROM lab")
def core_components(spark, sf):
    hood = D.Neighborhood(points(spark, sf), EPS_S, EPS_T, MIN_POINTS)
    return D.labels(hood).filter("flag = 'core'").select("id", "root")


@query("border_assign", NB + "SELECT id, root FROM allp WHERE flag = 'border'")
def border_assign(spark, sf):
    hood = D.Neighborhood(points(spark, sf), EPS_S, EPS_T, MIN_POINTS)
    return D.labels(hood).filter("flag = 'border'").select("id", "root")


GRAPH = CELLS + """, big AS (SELECT cell_id FROM hist),
be AS MATERIALIZED (SELECT src AS a, dst AS b FROM de WHERE src IN (SELECT cell_id FROM big) AND dst IN (SELECT cell_id FROM big)),
walk(node, root) AS (SELECT cell_id, cell_id FROM big UNION SELECT be.b, walk.root FROM walk JOIN be ON be.a = walk.node AND be.b > walk.root),
comp AS (SELECT node, min(root) AS root FROM walk GROUP BY node)
"""


def _cell_graph(spark, sf):
    """Graph of the cells."""
    hist = histogram(spark, sf)[2]
    return G.cell_adjacency(hist), hist.select(F.col("cell_id").alias("node"))


@query("connected_components", GRAPH + "SELECT node, root FROM comp")
def components(spark, sf):
    edges, nodes = _cell_graph(spark, sf)
    return connected_components(edges, nodes)


@query("graph_reachable", GRAPH + """SELECT s.node AS start, c.node FROM comp c JOIN (SELECT node, root FROM comp
WHERE node = (SELECT min(cell_id) FROM big)) s ON s.root = c.root AND s.node <> c.node""")
def graph_reachable(spark, sf):
    edges, nodes = _cell_graph(spark, sf)
    return reachable(connected_components(edges, nodes), nodes.agg(F.min("node").alias("node")))


def _copies(spark, sf):
    pts, corner, cubes = packed_cubes(spark, sf)
    return D.materialize(P.halo_assign(pts, cubes, corner, CELL, EPS_S, EPS_T))


LOCAL = HALO + """, cp AS MATERIALIZED (SELECT DISTINCT near.part, p.* FROM near JOIN p USING (id)),
nb AS MATERIALIZED (SELECT a.part, a.id ia, b.id ib FROM cp a JOIN cp b ON a.part = b.part
 AND b.t BETWEEN a.t-300 AND a.t+300 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 25),
core AS MATERIALIZED (SELECT part, ia FROM nb GROUP BY ALL HAVING count(*) >= 5),
ce AS MATERIALIZED (SELECT nb.part, nb.ia, nb.ib FROM nb JOIN core c1 ON nb.ia=c1.ia AND nb.part=c1.part
 JOIN core c2 ON nb.ib=c2.ia AND nb.part=c2.part),
cc(part, node, root) AS (SELECT part, ia, ia FROM core UNION
 SELECT ce.part, ce.ib, cc.root FROM cc JOIN ce ON ce.part = cc.part AND ce.ia = cc.node AND ce.ib > cc.root),
lab AS MATERIALIZED (SELECT part, node AS id, min(root) root FROM cc GROUP BY ALL),
touch AS MATERIALIZED (SELECT DISTINCT nb.part, nb.ia AS id, l.root FROM nb JOIN lab l ON nb.part = l.part AND nb.ib = l.id),
local AS MATERIALIZED (SELECT cp.part, cp.id, CASE WHEN lab.root IS NOT NULL THEN 'core' WHEN t.root IS NOT NULL THEN 'border' ELSE 'noise' END AS flag,
 coalesce(lab.root, t.root) AS root FROM cp LEFT JOIN lab USING (part, id)
 LEFT JOIN (SELECT part, id, min(root) AS root FROM touch GROUP BY ALL) t USING (part, id)),
contact AS MATERIALIZED (SELECT part, id, root FROM touch UNION SELECT part, id, root FROM local WHERE root IS NOT NULL),
linkable AS (SELECT c.*, first_value(part) OVER w AS p0, first_value(root) OVER w AS r0 FROM contact c
 WHERE id IN (SELECT id FROM lab) WINDOW w AS (PARTITION BY id ORDER BY part, root)),
link AS MATERIALIZED (SELECT DISTINCT part AS src_part, root AS src_root, p0 AS dst_part, r0 AS dst_root FROM linkable WHERE (part, root) <> (p0, r0)),
lk AS (SELECT src_part*1000000000+src_root AS a, dst_part*1000000000+dst_root AS b FROM link),
lk2 AS MATERIALIZED (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
lcl AS MATERIALIZED (SELECT DISTINCT part*1000000000+root AS node, root FROM local WHERE root IS NOT NULL),
walk(node, root) AS (SELECT node, node FROM lcl UNION SELECT lk2.b, walk.root FROM walk JOIN lk2 ON lk2.a = walk.node AND lk2.b > walk.root),
gid AS MATERIALIZED (SELECT node, root, dense_rank() OVER (ORDER BY g) AS cluster FROM (
 SELECT w.node, l.root, min(l.root) OVER (PARTITION BY w.top) AS g FROM (SELECT node, min(root) AS top FROM walk GROUP BY node) w
 JOIN lcl l ON l.node = w.node)),
done AS (SELECT l.id, CASE max(CASE flag WHEN 'core' THEN 2 WHEN 'border' THEN 1 ELSE 0 END) WHEN 2 THEN 'core' WHEN 1 THEN 'border' ELSE 'noise' END AS flag,
 coalesce(min(g.cluster), 0) AS cluster FROM local l LEFT JOIN contact c USING (part, id) LEFT JOIN gid g ON g.node = c.part*1000000000+c.root GROUP BY l.id)
"""


@query("local_clusters", LOCAL + "SELECT part, id, flag, root FROM local")
def local_clusters(spark, sf):
    return D.local_clusters(_copies(spark, sf), EPS_S, EPS_T, MIN_POINTS)[0]


@query("merge_edges", LOCAL + "SELECT * FROM link")
def merge_edges(spark, sf):
    labeled, contacts = D.local_clusters(_copies(spark, sf), EPS_S, EPS_T, MIN_POINTS)
    return D.merge_edges(labeled, contacts).select(
        F.col("src.part").alias("src_part"), F.col("src.root").alias("src_root"),
        F.col("dst.part").alias("dst_part"), F.col("dst.root").alias("dst_root"))


@query("global_cluster_ids", LOCAL + "SELECT node // 1000000000 AS part, root, cluster FROM gid")
def global_cluster_ids(spark, sf):
    labeled, contacts = D.local_clusters(_copies(spark, sf), EPS_S, EPS_T, MIN_POINTS)
    return D.global_cluster_ids(labeled, D.merge_edges(labeled, contacts)).select("part", "root", "cluster")


@query("resolve_labels", LOCAL + "SELECT id, flag, cluster FROM done")
def resolve_labels(spark, sf):
    labeled, contacts = D.local_clusters(_copies(spark, sf), EPS_S, EPS_T, MIN_POINTS)
    ids = D.global_cluster_ids(labeled, D.merge_edges(labeled, contacts))
    return D.resolve_labels(labeled, contacts, ids)


@query("st_dbscan_partitioned", ST_DBSCAN_SQL)
def st_dbscan_partitioned(spark, sf):
    return D.st_dbscan_partitioned(_copies(spark, sf), EPS_S, EPS_T, MIN_POINTS)
