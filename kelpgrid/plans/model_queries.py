"""Registered queries: marginals and shares of parameters in forests.

The trees of the compared queries are made by Spark from lineitem: one per return
flag, cut at averages of quantity, discount and tax and by a category, each leaf
holding the mean price of its rows.  DuckDB gets the same leaves and takes
variances from the overlap of pairs of leaves instead of cells.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from kelpgrid.functions.expressions import r
from kelpgrid.operators import boxes as B
from kelpgrid.plans.fixtures import table
from kelpgrid.plans.registry import query
from kelpgrid.session import materialize

DOMAIN = {"quantity": (1.0, 50.0), "discount": (0.0, 0.11), "tax": (0.0, 0.09), "kind": ["a", "b", "c"]}
NAMES = list(DOMAIN)

LEAVES_SQL = """WITH li AS (SELECT l_returnflag AS tree, l_quantity AS q, l_discount AS d, l_tax AS t, CASE l_linenumber % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'a' ELSE 'b' END AS k, l_extendedprice AS y FROM lineitem),
s1 AS (SELECT *, floor(avg(q) OVER (PARTITION BY tree)) + 0.5 AS qc FROM li),
s2 AS (SELECT *, (floor(avg(d) OVER (PARTITION BY tree, q > qc) * 100) + 0.5) / 100 AS dc FROM s1),
s3 AS (SELECT *, (floor(avg(t) OVER (PARTITION BY tree, q > qc, d > dc) * 100) + 0.5) / 100 AS tc FROM s2),
g AS (SELECT tree, q > qc AS q1, d > dc AS d1, t > tc AS t1, k = 'c' AS k1, any_value(qc) AS qc, any_value(dc) AS dc, any_value(tc) AS tc, avg(y) AS v FROM s3 GROUP BY ALL),
lv AS (SELECT tree, v, CASE WHEN q1 THEN qc ELSE 1e0 END AS quantity_lo, CASE WHEN q1 THEN 50e0 ELSE qc END AS quantity_hi, CASE WHEN d1 THEN dc ELSE 0e0 END AS discount_lo, CASE WHEN d1 THEN 0.11e0 ELSE dc END AS discount_hi,
 CASE WHEN t1 THEN tc ELSE 0e0 END AS tax_lo, CASE WHEN t1 THEN 0.09e0 ELSE tc END AS tax_hi, k1 AS kind FROM g),
sh AS (SELECT *, row_number() OVER () AS n, (quantity_hi - quantity_lo) / 49e0 AS quantity, (discount_hi - discount_lo) / 0.11e0 AS discount, (tax_hi - tax_lo) / 0.09e0 AS tax, CASE WHEN kind THEN 1e0 ELSE 2e0 END / 3 AS kind_share FROM lv)
"""
SHARE = {"quantity": "quantity", "discount": "discount", "tax": "tax", "kind": "kind_share"}
LENGTH = {"quantity": "49e0", "discount": "0.11e0", "tax": "0.09e0"}


def _tree_rows(spark, sf):
    n = F.col("l_linenumber") % 3
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("tree"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.when(n == 0, "c").when(n == 1, "a").otherwise("b").alias("kind"), F.col("l_extendedprice").alias("y"))


def _boxes(spark, sf):
    """Trees cut at averages, level by level; a level reads sums by value, not the rows again."""
    keys = ["quantity", "discount", "tax", "kind"]
    values = materialize(_tree_rows(spark, sf).groupBy("tree", *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")))
    path, rows = ["tree"], values
    for c, unit in (("quantity", 1), ("discount", 100), ("tax", 100)):
        mean = F.sum(F.col(c) * F.col("n")) / F.sum("n")
        cuts = rows.groupBy(*path).agg(((F.floor(mean * unit) + 0.5) / unit).alias(f"{c}_cut"))
        rows = rows.join(cuts, path).withColumn(f"{c}_up", F.col(c) > F.col(f"{c}_cut"))
        path.append(f"{c}_up")
    rows = rows.withColumn("last", F.col("kind") == "c")
    leaves = rows.groupBy(*path, "last").agg((F.sum("y") / F.sum("n")).alias("value"), *[F.first(f"{c}_cut").alias(f"{c}_cut") for c in NAMES[:3]])
    sides = [x for c in NAMES[:3] for x in (F.lit(c), B.side(DOMAIN[c], F.when(F.col(f"{c}_up"), F.col(f"{c}_cut")), F.when(~F.col(f"{c}_up"), F.col(f"{c}_cut"))))]
    kinds = F.when(F.col("last"), F.array(F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    leaf = F.concat_ws("", *[F.col(f"{c}_up").cast("int") for c in NAMES[:3]], F.col("last").cast("int"))
    return materialize(leaves.select("tree", leaf.alias("leaf"), "value", F.create_map(*sides, F.lit("kind"), B.side(DOMAIN["kind"], choices=kinds)).alias("sides")))


def _shares_sql(order):
    """Variance of a marginal: products of leaf values weighted by overlap in the set and by shares in all other parameters."""
    sets = [s for k in range(1, order + 1) for s in combinations(sorted(NAMES), k)]

    def both(p, inside):
        if not inside:
            return f"a.{SHARE[p]} * b.{SHARE[p]}"
        return "CASE WHEN a.kind = b.kind THEN a.kind_share ELSE 0 END" if p == "kind" else f"greatest(0, least(a.{p}_hi, b.{p}_hi) - greatest(a.{p}_lo, b.{p}_lo)) / {LENGTH[p]}"
    volume = " * ".join(SHARE[p] for p in NAMES)
    total = f"(a.n = b.n)::INT * {' * '.join(f'a.{SHARE[p]}' for p in NAMES)}"
    v = [f"sum(a.c * b.c * {' * '.join(both(p, p in s) for p in NAMES)}) AS \"v_{'_'.join(s)}\"" for s in sets]
    own, outer = [], []
    for k in range(1, order + 1):
        level = []
        for s in combinations(sorted(NAMES), k):
            low = [f"o_{'_'.join(x)}" for j in range(1, k) for x in combinations(s, j)]
            level.append(f"greatest(0, v_{'_'.join(s)}{''.join(f' - {x}' for x in low)}) AS o_{'_'.join(s)}")
            outer.append(f"SELECT '{','.join(s)}' AS params, round(avg(o_{'_'.join(s)} / total), 6) AS individual, round(avg(v_{'_'.join(s)} / total), 6) AS total,"
                         f" round(stddev_pop(o_{'_'.join(s)} / total), 6) AS individual_std, round(stddev_pop(v_{'_'.join(s)} / total), 6) AS total_std FROM o{order}")
        own.append(f"o{k} AS (SELECT *, {', '.join(level)} FROM {'pv' if k == 1 else f'o{k - 1}'})")
    return (LEAVES_SQL + f", ce AS (SELECT *, v - sum(v * {volume}) OVER (PARTITION BY tree) / sum({volume}) OVER (PARTITION BY tree) AS c FROM sh),\n"
            + f"pv AS (SELECT a.tree, sum(a.c * b.c * {total}) AS total, {', '.join(v)} FROM ce a JOIN ce b ON a.tree = b.tree GROUP BY 1),\n"
            + ", ".join(own) + " " + " UNION ALL ".join(outer))


@query("anova_model", _shares_sql(3))
def anova_model(spark, sf):
    out = B.model_shares(_boxes(spark, sf), NAMES, 3)
    return out.select("params", *[r(c).alias(c) for c in ("individual", "total", "individual_std", "total_std")])


CURVE = B.grid(DOMAIN["quantity"], 25)
LOG_CURVE = B.grid(DOMAIN["quantity"], 25, log=True)


def _at(values):
    return f"unnest([{', '.join(repr(x) + 'e0' if 'e' not in repr(x) else repr(x) for x in values)}])"


def _curve_sql(values, label):
    return f"""SELECT '{label}' AS scale, round(x, 6) AS quantity, round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS std FROM (
 SELECT tree, x, sum(v * discount * tax * kind_share) AS m FROM sh JOIN (SELECT {_at(values)} AS x) ON x > quantity_lo AND x <= quantity_hi OR x = 1 AND quantity_lo = 1 GROUP BY ALL) GROUP BY x"""


@query("marginal_model_curve", LEAVES_SQL + _curve_sql(CURVE, "linear") + " UNION ALL " + _curve_sql(LOG_CURVE, "log"))
def marginal_model_curve(spark, sf):
    boxes = _boxes(spark, sf)
    both = [B.model_marginal(boxes, DOMAIN, {"quantity": x}).withColumn("scale", F.lit(n)) for n, x in (("linear", CURVE), ("log", LOG_CURVE))]
    return both[0].unionByName(both[1]).select("scale", r("quantity").alias("quantity"), r("mean", 4).alias("mean"), r("std", 4).alias("std"))


SURFACE = B.grid(DOMAIN["tax"], 10)


@query("marginal_model_surface", LEAVES_SQL + f"""SELECT round(x, 6) AS tax, k AS kind, round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS std FROM (
 SELECT tree, x, k, sum(v * quantity * discount) AS m FROM sh JOIN (SELECT {_at(SURFACE)} AS x) ON x > tax_lo AND x <= tax_hi OR x = 0 AND tax_lo = 0
 JOIN (SELECT unnest(['a', 'b', 'c']) AS k) ON (k = 'c') = kind GROUP BY ALL) GROUP BY x, k""")
def marginal_model_surface(spark, sf):
    out = B.model_marginal(_boxes(spark, sf), DOMAIN, {"tax": SURFACE, "kind": DOMAIN["kind"]})
    return out.select(r("tax").alias("tax"), "kind", r("mean", 4).alias("mean"), r("std", 4).alias("std"))


@query("anova_forest")
def anova_forest(spark, sf):
    """Shares in a fitted forest; no SQL, the tests compare with its predictions."""
    names = NAMES[:3]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(_tree_rows(spark, sf).select(*names, "y"))
    model = RandomForestRegressor(labelCol="y", numTrees=16, maxDepth=6, seed=1).fit(rows)
    return B.model_shares(B.forest_boxes(model, names, {n: DOMAIN[n] for n in names}), names, 3)
