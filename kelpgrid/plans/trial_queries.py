"""Registered queries: run histories and Pareto fronts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpgrid.functions.expressions import r
from kelpgrid.operators import pareto as P
from kelpgrid.operators import importance as I
from kelpgrid.operators import trials as H
from kelpgrid.operators.metric import nearest_vectors
from kelpgrid.operators.nearest import nearest_distance
from kelpgrid.plans.fixtures import ORACLE_PART_TRIALS, ORACLE_TRIALS, part_trials, table, trials
from kelpgrid.plans.registry import query
from kelpgrid.session import materialize

CONFIG = ["quantity", "discount", "tax", "status"]
OBJ = ["f1", "f2"]
DEFAULT = {"quantity": 25.0, "discount": 0.05, "tax": 0.04}
T = f"""WITH {ORACLE_TRIALS},
st AS (SELECT *, CASE WHEN trial_state <> 0 THEN 'failed' WHEN c1 > 0 THEN 'infeasible' ELSE 'success' END AS outcome FROM trials),
imp AS (SELECT *, CASE WHEN outcome = 'success' THEN f1 ELSE max(CASE WHEN outcome <> 'failed' THEN f1 END)
 OVER (PARTITION BY task_id) END AS y FROM st)
"""
REF, IDEAL = (100000.0, 0.0), (0.0, -60.0)


def status():
    return H.trial_status("trial_state", OBJ, ["c1"])


def ok_trials(spark, sf, numbered=True):
    return trials(spark, sf, numbered).filter(status() == "success")


def _imputed(spark, sf):
    return H.impute_failed(trials(spark, sf), "f1", status())


@query("objective_values", T + """SELECT task_id, iter, f1 AS obj1, -quantity AS obj2, CAST(NULL AS DOUBLE) AS obj3 FROM trials""")
def objective_values(spark, sf):
    t = trials(spark, sf)
    resource = F.create_map(F.lit("quantity"), F.col("quantity"))
    t = t.withColumn("m", F.map_concat(F.create_map(F.lit("price"), F.col("f1")), resource))
    return t.select("task_id", "iter", *[c.alias(n) for n, c in H.objective_values("m", ["-price", "quantity", "absent"]).items()])


@query("constraint_values", T + "SELECT task_id, iter, round(tax - 0.06, 6) + 0.0 AS c1, round((quantity - 40) * discount, 6) + 0.0 AS c2 FROM trials")
def constraint_values(spark, sf):
    c1, c2 = H.constraint_values(["tax - 0.06", "(quantity - 40) * discount"], {"tax", "quantity", "discount"})
    return trials(spark, sf).select("task_id", "iter", r(c1.cast("double")).alias("c1"), r(c2).alias("c2"))


@query("trial_status", T + "SELECT task_id, iter, outcome FROM st")
def trial_status(spark, sf):
    return trials(spark, sf).select("task_id", "iter", status().alias("outcome"))


@query("append_observation", T + """SELECT task_id, count(*) AS n_trials, count(*) FILTER (outcome = 'success') AS n_success,
count(*) FILTER (outcome = 'failed') AS n_failed, min(CASE WHEN outcome = 'success' THEN f1 END) AS best FROM st GROUP BY task_id""")
def append_observation(spark, sf):
    t = trials(spark, sf, False)
    return H.history_summary(H.append_observation(t.filter("status = 'O'"), t.filter("status <> 'O'")), "f1", status())


STATE_SQL = T + """, ap AS (SELECT *, '-price,' || task_id AS info, outcome <> 'failed' AS done FROM st)
SELECT task_id, any_value(info) AS info, count(*) AS n_trials, count(*) FILTER (outcome = 'success') AS n_success, count(*) FILTER (outcome = 'failed') AS n_failed, count(*) FILTER (outcome = 'infeasible') AS n_infeasible,
min(f1) FILTER (outcome = 'success') AS best, round(quantile_cont(f1, 0.05) FILTER (done), 4) AS p5, min(f1) FILTER (done) AS min_y, max(f1) FILTER (done) AS max_y FROM ap GROUP BY task_id"""


@query("append_state", STATE_SQL)
def append_state(spark, sf):
    """Runs arrive in three batches; each is aggregated alone and added to the kept state."""
    t = trials(spark, sf, False).withColumn("info", F.concat(F.lit("-price,"), "task_id"))
    kept = None
    for batch in (t.filter("quantity <= 17"), t.filter("quantity > 17 and quantity <= 34"), t.filter("quantity > 34 or quantity is null")):
        new = H.history_state(batch, "f1", status(), "info")
        kept = materialize(new if kept is None else H.merge_states(kept, new))
    return H.state_summary(kept).withColumn("p5", r("p5", 4))


@query("list_trials", T + "SELECT task_id, iter, quantity, status, f1 AS y0, f2 AS y1, tax AS context FROM trials")
def list_trials(spark, sf):
    rows = H.list_trials(trials(spark, sf), CONFIG, ["f1", "f2"], ["tax"])
    return rows.select("task_id", "iter", "configuration.quantity", "configuration.status", F.get("objectives", 0).alias("y0"), F.get("objectives", 1).alias("y1"), F.get("context", 0).alias("context"))


@query("fill_defaults", T + """SELECT task_id, iter, coalesce(nullif(discount, 0), 0.05) AS discount,
coalesce(nullif(status, 'F'), 'O') AS status, 'lz4' AS codec FROM trials""")
def fill_defaults(spark, sf):
    t = trials(spark, sf).withColumns({"discount": F.nullif("discount", F.lit(0.0)), "status": F.nullif("status", F.lit("F"))})
    return H.fill_defaults(t, {"discount": 0.05, "status": "O", "codec": "lz4"}).select("task_id", "iter", "discount", "status", "codec")


@query("change_space", T + "SELECT task_id, iter, quantity, tax, 32 AS buffer FROM trials")
def change_space(spark, sf):
    return H.change_space(trials(spark, sf), ["quantity", "tax", "buffer"], {"quantity": 25.0, "tax": 0.04, "buffer": 32}, ["task_id", "iter"])


@query("impute_failed", T + "SELECT task_id, iter, y FROM imp")
def impute_failed(spark, sf):
    return _imputed(spark, sf).select("task_id", "iter", "y")


@query("impute_constraints", T + """SELECT task_id, iter, round(sign(v) * ln(1 + abs(v)), 6) + 0.0 AS c FROM (SELECT task_id, iter,
CASE WHEN outcome <> 'failed' THEN c1 ELSE coalesce(max(c1) OVER (PARTITION BY task_id), 1.0) END AS v FROM st)""")
def impute_constraints(spark, sf):
    return H.impute_constraints(trials(spark, sf), "c1", status()).select("task_id", "iter", r("c").alias("c"))


@query("history_stats", T + """SELECT task_id, round(quantile_cont(f1, 0.05), 6) AS p5, min(f1) AS min_y, max(f1) AS max_y
FROM st WHERE outcome <> 'failed' GROUP BY task_id""")
def history_stats(spark, sf):
    return H.history_stats(trials(spark, sf, False), "f1", status()).withColumn("p5", r("p5"))


@query("dedup_configs", T + """SELECT task_id, quantity, discount, tax, status, min(iter) AS iter, min_by(f1, iter) AS f1
FROM trials GROUP BY ALL""")
def dedup_configs(spark, sf):
    return H.dedup_configs(trials(spark, sf).select("task_id", "iter", *CONFIG, "f1"), CONFIG)


INC = T + """, fst AS (SELECT task_id, quantity, discount, tax, status, min(iter) AS iter, min_by(f1, iter) AS f1 FROM st
 WHERE outcome = 'success' GROUP BY ALL),
inc AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY task_id ORDER BY f1) AS k FROM fst) WHERE k = 1)
"""


def _incumbents(spark, sf):
    return H.incumbents(ok_trials(spark, sf).select("task_id", "iter", *CONFIG, "f1"), "f1", CONFIG)


@query("incumbents", INC + "SELECT task_id, iter, quantity, discount, tax, status, f1 FROM inc")
def incumbents(spark, sf):
    return _incumbents(spark, sf)


@query("trial_lookup", T + "SELECT task_id, iter, f1, trial_state FROM trials WHERE quantity = 7 AND discount = 0.05 AND tax = 0.04 AND status = 'O'")
def trial_lookup(spark, sf):
    return H.trial_lookup(trials(spark, sf), {"quantity": 7.0, "discount": 0.05, "tax": 0.04, "status": "O"}, ["task_id", "iter", "f1", "trial_state"])


@query("incumbent_report", INC + """SELECT task_id, row_number() OVER (PARTITION BY task_id, parameter ORDER BY iter) AS incumbent,
count(*) OVER (PARTITION BY task_id, parameter) AS n_incumbents, f1, parameter, value FROM (
 SELECT task_id, iter, f1, unnest(['quantity', 'discount', 'tax', 'status']) AS parameter,
 unnest([CAST(quantity AS VARCHAR), CAST(discount AS VARCHAR), CAST(tax AS VARCHAR), status]) AS value FROM inc)""")
def incumbent_report(spark, sf):
    return H.incumbent_report(_incumbents(spark, sf), "f1", CONFIG)


@query("convergence", T + """, cv AS (SELECT task_id, iter, f1, min(f1) OVER (PARTITION BY task_id ORDER BY iter) AS running_min FROM trials)
SELECT task_id, iter, running_min, least(f1, max(running_min) OVER (PARTITION BY task_id)) AS clipped FROM cv""")
def convergence(spark, sf):
    return H.convergence(trials(spark, sf), "f1").select("task_id", "iter", "running_min", "clipped")


DEF = T + """, def AS (SELECT task_id, coalesce(avg(CASE WHEN quantity = 25 AND discount = 0.05 AND tax = 0.04 THEN y END), min_by(y, iter)) AS default_perf
 FROM imp GROUP BY task_id)
"""


@query("default_perf", DEF + "SELECT task_id, round(default_perf, 4) AS default_perf FROM def")
def default_perf(spark, sf):
    return H.default_perf(_imputed(spark, sf), "y", DEFAULT).withColumn("default_perf", r("default_perf", 4))


REGION = DEF + """, th AS (SELECT task_id, least(quantile_cont(y, 1 - 0.9), any_value(default_perf)) AS threshold FROM imp JOIN def USING (task_id) GROUP BY task_id),
lg AS (SELECT task_id, y <= threshold AS good, unnest(['quantity', 'discount', 'tax']) AS knob, unnest([quantity, discount, tax]) AS v FROM imp JOIN th USING (task_id)),
span AS (SELECT task_id, knob, min(v) AS lo, max(v) AS hi FROM lg WHERE good GROUP BY ALL)
"""


def _threshold(imputed):
    return H.promising_threshold(imputed, "y", DEFAULT, quantile=0.9)


@query("promising_region", REGION + """SELECT task_id, knob, coalesce(max(v) FILTER (NOT good AND v < lo), any_value(lo)) AS low,
coalesce(min(v) FILTER (NOT good AND v > hi), any_value(hi)) AS high FROM lg JOIN span USING (task_id, knob) GROUP BY ALL""")
def promising_region(spark, sf):
    t = materialize(_imputed(spark, sf))
    return H.promising_region(t, "y", _threshold(t), ["quantity", "discount", "tax"])


@query("promising_importance", REGION + """, imps AS (SELECT 'quantity' AS knob, (SELECT var_pop(m) FROM (SELECT avg(f1) AS m FROM trials GROUP BY quantity)) / (SELECT var_pop(f1) FROM trials) AS v
 UNION ALL SELECT 'discount', (SELECT var_pop(m) FROM (SELECT avg(f1) AS m FROM trials GROUP BY discount)) / (SELECT var_pop(f1) FROM trials))
SELECT task_id, knob, coalesce(max(v0) FILTER (NOT good AND v0 < lo), any_value(lo)) AS low, coalesce(min(v0) FILTER (NOT good AND v0 > hi), any_value(hi)) AS high,
 round(any_value(w) / abs(any_value(default_perf)) * 1e6, 6) AS importance FROM (SELECT lg.task_id, lg.knob, good, lg.v AS v0, lo, hi, imps.v AS w, default_perf
 FROM lg JOIN span USING (task_id, knob) LEFT JOIN imps ON imps.knob = lg.knob JOIN def ON def.task_id = lg.task_id) GROUP BY ALL""")
def promising_importance(spark, sf):
    """Regions with the share of the objective's variance between the values of each knob; ``tax`` has none."""
    t = materialize(_imputed(spark, sf))
    region = H.promising_region(t, "y", _threshold(t), ["quantity", "discount", "tax"])
    share = I.anova_main(trials(spark, sf, False), ["quantity", "discount"], "f1").select(F.col("params").alias("knob"), F.col("share").alias("importance"))
    out = H.normalized_importance(region, share, H.default_perf(t, "y", DEFAULT))
    return out.select("task_id", "knob", "low", "high", r(F.col("importance") * 1e6).alias("importance"))


@query("promising_categories", REGION + "SELECT DISTINCT task_id, 'status' AS knob, status AS value FROM imp JOIN th USING (task_id) WHERE y <= threshold")
def promising_categories(spark, sf):
    t = materialize(_imputed(spark, sf))
    return H.promising_categories(t, "y", _threshold(t), ["status"])


FRONT = T + """, low AS (SELECT task_id, f2, min(f1) AS f1 FROM st WHERE outcome = 'success' GROUP BY ALL),
edge AS (SELECT * FROM low a WHERE NOT EXISTS (SELECT 1 FROM low b WHERE b.task_id = a.task_id AND b.f1 <= a.f1 AND b.f2 <= a.f2
 AND (b.f1 < a.f1 OR b.f2 < a.f2))),
front AS (SELECT st.* FROM st JOIN edge USING (task_id, f1, f2) WHERE outcome = 'success')
"""


@query("pareto_front", FRONT + "SELECT task_id, iter, f1, f2 FROM front")
def pareto_front(spark, sf):
    return P.pareto_front(ok_trials(spark, sf).select("task_id", "iter", "f1", "f2"), H.KEYS, OBJ)


@query("pareto_front_distinct", FRONT + "SELECT task_id, min(iter) AS iter, f1, f2 FROM front GROUP BY ALL")
def pareto_front_distinct(spark, sf):
    return P.pareto_front_distinct(ok_trials(spark, sf).select("task_id", "iter", "f1", "f2"), H.KEYS, OBJ)


@query("pareto_front_3d", T + """, s3 AS (SELECT DISTINCT task_id, f1, f2, tax FROM st WHERE outcome = 'success'),
l3 AS (SELECT task_id, min(f1) AS f1, f2, tax FROM s3 GROUP BY ALL)
SELECT a.* FROM l3 a WHERE NOT EXISTS (SELECT 1 FROM l3 b WHERE a.task_id = b.task_id AND b.f1 <= a.f1 AND b.f2 <= a.f2 AND b.tax <= a.tax
 AND (b.f1 < a.f1 OR b.f2 < a.f2 OR b.tax < a.tax))""")
def pareto_front_3d(spark, sf):
    t = ok_trials(spark, sf).select("task_id", "iter", "f1", "f2", "tax")
    return P.pareto_front_distinct(t, H.KEYS, ["f1", "f2", "tax"]).select("task_id", "f1", "f2", "tax")


FRONT4 = T + """, l4 AS (SELECT task_id, min(f1) AS f1, f2, tax, discount FROM st WHERE outcome = 'success' GROUP BY ALL)
"""
OBJ4 = ["f1", "f2", "tax", "discount"]


def _front4(spark, sf):
    return P.pareto_front_distinct(ok_trials(spark, sf).select("task_id", "iter", *OBJ4), H.KEYS, OBJ4)


@query("pareto_front_4d", FRONT4 + """SELECT a.* FROM l4 a WHERE NOT EXISTS (SELECT 1 FROM l4 b WHERE a.task_id = b.task_id AND b.f1 <= a.f1 AND b.f2 <= a.f2
 AND b.tax <= a.tax AND b.discount <= a.discount AND (b.f1 < a.f1 OR b.f2 < a.f2 OR b.tax < a.tax OR b.discount < a.discount))""")
def pareto_front_4d(spark, sf):
    return _front4(spark, sf).select("task_id", *OBJ4)


# Failed runs have no first objective, and one task has no name.
FAILED = f"""WITH {ORACLE_TRIALS}, ft AS (SELECT nullif(task_id, 'N') AS task_id, iter, CASE WHEN trial_state = 0 THEN f1 END AS f1, f2 FROM trials),
low AS (SELECT task_id, f2, min(f1) AS f1 FROM ft WHERE f1 IS NOT NULL GROUP BY ALL),
edge AS (SELECT * FROM low a WHERE NOT EXISTS (SELECT 1 FROM low b WHERE b.task_id IS NOT DISTINCT FROM a.task_id AND b.f1 <= a.f1 AND b.f2 <= a.f2
 AND (b.f1 < a.f1 OR b.f2 < a.f2)))
"""


def failed_trials(spark, sf):
    t = trials(spark, sf)
    return t.select(F.nullif("task_id", F.lit("N")).alias("task_id"), "iter", F.when(F.col("trial_state") == 0, F.col("f1")).alias("f1"), "f2")


@query("pareto_front_failed", FAILED + "SELECT ft.* FROM ft JOIN edge ON ft.task_id IS NOT DISTINCT FROM edge.task_id AND ft.f1 = edge.f1 AND ft.f2 = edge.f2")
def pareto_front_failed(spark, sf):
    return P.pareto_front(failed_trials(spark, sf), H.KEYS, OBJ)


@query("pareto_front_distinct_failed", FAILED + """SELECT ft.task_id, min(iter) AS iter, ft.f1, ft.f2 FROM ft
JOIN edge ON ft.task_id IS NOT DISTINCT FROM edge.task_id AND ft.f1 = edge.f1 AND ft.f2 = edge.f2 GROUP BY ALL""")
def pareto_front_distinct_failed(spark, sf):
    return P.pareto_front_distinct(failed_trials(spark, sf), H.KEYS, OBJ)


@query("objective_incumbents_failed", FAILED + """, lg AS (SELECT task_id, iter, unnest(['f1', 'f2']) AS objective, unnest([f1, f2]) AS value FROM ft)
SELECT task_id, iter, objective, value FROM (SELECT *, rank() OVER (PARTITION BY task_id, objective ORDER BY value) AS k FROM lg WHERE value IS NOT NULL) WHERE k = 1""")
def objective_incumbents_failed(spark, sf):
    return P.objective_incumbents(failed_trials(spark, sf), H.KEYS, OBJ)


HIST = f"""WITH {ORACLE_PART_TRIALS}, ent AS (SELECT * FROM part_trials a WHERE NOT EXISTS (SELECT 1 FROM part_trials b
 WHERE b.task_id = a.task_id AND b.iter < a.iter AND b.f1 <= a.f1 AND b.f2 <= a.f2)),
ph AS (SELECT a.task_id, a.iter AS entered, a.f1, a.f2, (SELECT min(b.iter) FROM part_trials b WHERE b.task_id = a.task_id
 AND b.iter > a.iter AND b.f1 <= a.f1 AND b.f2 <= a.f2) AS "left" FROM ent a)
"""


def _history(spark, sf):
    return P.pareto_history(part_trials(spark, sf), H.KEYS, "f1", "f2")


@query("pareto_history", HIST + """SELECT task_id, entered, "left", f1, f2 FROM ph""")
def pareto_history(spark, sf):
    return _history(spark, sf).select("task_id", "entered", "left", "f1", "f2")


HIST_FAILED = """WITH part_trials AS (SELECT nullif(p_brand, 'Brand#13') AS task_id, p_partkey AS iter, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS f1,
 -CAST(p_size AS DOUBLE) AS f2 FROM part), kn AS (SELECT * FROM part_trials WHERE f1 IS NOT NULL), ent AS (SELECT * FROM kn a WHERE NOT EXISTS (SELECT 1 FROM kn b
 WHERE b.task_id IS NOT DISTINCT FROM a.task_id AND b.iter < a.iter AND b.f1 <= a.f1 AND b.f2 <= a.f2))
SELECT task_id, iter AS entered, f1, f2, (SELECT min(b.iter) FROM kn b WHERE b.task_id IS NOT DISTINCT FROM a.task_id
 AND b.iter > a.iter AND b.f1 <= a.f1 AND b.f2 <= a.f2) AS "left" FROM ent a"""


@query("pareto_history_failed", HIST_FAILED)
def pareto_history_failed(spark, sf):
    t = part_trials(spark, sf).withColumns({"task_id": F.nullif("task_id", F.lit("Brand#13")), "f1": F.when(F.col("iter") % 5 != 0, F.col("f1"))})
    return P.pareto_history(t, H.KEYS, "f1", "f2").select("task_id", "entered", "left", "f1", "f2")


@query("hypervolume_history", HIST + """, al AS (SELECT s.task_id, s.entered AS iter, h.f1, h.f2 FROM ph s JOIN ph h ON s.task_id = h.task_id
 AND h.entered <= s.entered AND (h."left" IS NULL OR h."left" > s.entered) WHERE h.f1 < 2000 AND h.f2 < 0),
ar AS (SELECT task_id, iter, (2000 - f1) * (coalesce(lag(f2) OVER (PARTITION BY task_id, iter ORDER BY f1), 0) - f2) AS a FROM al)
SELECT task_id, entered AS iter, coalesce(round(sum(a), 4), 0) AS hypervolume FROM ph LEFT JOIN ar ON ph.task_id = ar.task_id AND ph.entered = ar.iter
GROUP BY ALL""".replace("SELECT task_id, entered AS iter, coalesce", "SELECT ph.task_id, entered AS iter, coalesce"))
def hypervolume_history(spark, sf):
    hist = materialize(_history(spark, sf))
    return P.hypervolume_history(hist, H.KEYS, "f1", "f2", (2000.0, 0.0)).withColumn("hypervolume", r("hypervolume", 4))


@query("objective_incumbents", T + """, lg AS (SELECT task_id, iter, unnest(['f1', 'f2']) AS objective, unnest([f1, f2]) AS value FROM st WHERE outcome = 'success')
SELECT task_id, iter, objective, value FROM (SELECT *, rank() OVER (PARTITION BY task_id, objective ORDER BY value) AS k FROM lg) WHERE k = 1""")
def objective_incumbents(spark, sf):
    return P.objective_incumbents(ok_trials(spark, sf), H.KEYS, OBJ)


HV = FRONT + """, fd AS (SELECT DISTINCT task_id, f1, f2 FROM front),
pv AS (SELECT *, lag(f1) OVER w AS p1, lag(f2) OVER w AS p2 FROM fd WINDOW w AS (PARTITION BY task_id ORDER BY f1)),
hv AS (SELECT task_id, sum((100000.0::DOUBLE - f1) * (coalesce(p2, 0) - f2)) AS hypervolume FROM pv GROUP BY task_id),
cells AS (SELECT task_id, coalesce(p1, 0) AS a0, f1 AS a1, -60.0::DOUBLE AS b0, coalesce(p2, 0) AS b1 FROM pv
 UNION ALL SELECT task_id, max(f1), 100000.0::DOUBLE, -60.0::DOUBLE, min(f2) FROM fd GROUP BY task_id)
"""


@query("hypervolume", HV + "SELECT task_id, round(hypervolume, 3) AS hypervolume FROM hv")
def hypervolume(spark, sf):
    front = materialize(P.pareto_front(ok_trials(spark, sf, False).select("task_id", "f1", "f2"), H.KEYS, OBJ))
    return P.hypervolume_2d(front, H.KEYS, "f1", "f2", REF).withColumn("hypervolume", r("hypervolume", 3))


@query("hypervolume_3d", T + """, l3 AS (SELECT task_id, min(f1) AS f1, f2, tax FROM st WHERE outcome = 'success' GROUP BY ALL),
z AS (SELECT DISTINCT task_id, tax FROM l3), zs AS (SELECT *, coalesce(lead(tax) OVER (PARTITION BY task_id ORDER BY tax), 0.1) - tax AS h FROM z),
m AS (SELECT zs.task_id, zs.tax AS z, h, f2, min(f1) AS f1 FROM zs JOIN l3 ON l3.task_id = zs.task_id AND l3.tax <= zs.tax AND f1 < 100000 AND f2 < 0 GROUP BY ALL),
u AS (SELECT *, least(coalesce(min(f1) OVER (PARTITION BY task_id, z ORDER BY f2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100000), 100000) AS cap FROM m)
SELECT task_id, round(sum(h * greatest(cap - f1, 0) * (0 - f2)), 1) AS hypervolume FROM u GROUP BY task_id""")
def hypervolume_3d(spark, sf):
    t = ok_trials(spark, sf).select("task_id", "iter", "f1", "f2", "tax")
    front = P.pareto_front_distinct(t, H.KEYS, ["f1", "f2", "tax"])
    return P.hypervolume(front, H.KEYS, ["f1", "f2", "tax"], (100000.0, 0.0, 0.1)).withColumn("hypervolume", r("hypervolume", 1))


@query("hypervolume_4d", FRONT4 + """, z AS (SELECT *, coalesce(lead(tax) OVER (PARTITION BY task_id ORDER BY tax), 0.1) - tax AS h FROM (SELECT DISTINCT task_id, tax FROM l4)),
w AS (SELECT *, coalesce(lead(discount) OVER (PARTITION BY task_id ORDER BY discount), 0.2) - discount AS g FROM (SELECT DISTINCT task_id, discount FROM l4)),
m AS (SELECT z.task_id, z.tax AS z, w.discount AS w, h * g AS h, f2, min(f1) AS f1 FROM z JOIN w USING (task_id)
 JOIN l4 ON l4.task_id = z.task_id AND l4.tax <= z.tax AND l4.discount <= w.discount AND f1 < 100000 AND f2 < 0 GROUP BY ALL),
u AS (SELECT *, least(coalesce(min(f1) OVER (PARTITION BY task_id, z, w ORDER BY f2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100000), 100000) AS cap FROM m)
SELECT task_id, round(sum(h * greatest(cap - f1, 0) * (0 - f2)), 1) AS hypervolume FROM u GROUP BY task_id""")
def hypervolume_4d(spark, sf):
    front = materialize(_front4(spark, sf))
    return P.hypervolume(front, H.KEYS, OBJ4, (100000.0, 0.0, 0.1, 0.2)).withColumn("hypervolume", r("hypervolume", 1))


def _cells(spark, sf):
    front = materialize(P.pareto_front(ok_trials(spark, sf, False).select("task_id", "f1", "f2"), H.KEYS, OBJ))
    return P.nondominated_cells_2d(front, H.KEYS, "f1", "f2", REF, IDEAL)


@query("nondominated_cells_2d", HV + "SELECT task_id, a0, a1, b0, b1 FROM cells")
def nondominated_cells_2d(spark, sf):
    return _cells(spark, sf)


@query("dominated_volume_2d", HV + "SELECT task_id, round(6000000.0::DOUBLE - sum((a1 - a0) * (b1 - b0)), 3) AS volume FROM cells GROUP BY task_id")
def dominated_volume_2d(spark, sf):
    return P.dominated_volume_2d(_cells(spark, sf), H.KEYS, REF, IDEAL).withColumn("volume", r("volume", 3))


@query("chebyshev", T + """SELECT task_id, iter, round(greatest(a, b) + 0.05 * (a + b), 6) AS scalar FROM (SELECT task_id, iter,
0.7 * ((f1 - min(f1) OVER w) / (max(f1) OVER w - min(f1) OVER w)) AS a, 0.3 * ((f2 - min(f2) OVER w) / (max(f2) OVER w - min(f2) OVER w)) AS b
FROM trials WINDOW w AS (PARTITION BY task_id))""")
def chebyshev(spark, sf):
    return P.chebyshev(trials(spark, sf), H.KEYS, OBJ, [0.7, 0.3]).select("task_id", "iter", r("scalar").alias("scalar"))


def _restarts(spark, sf):
    """Runs of one task; every (brand) history is one restart of it."""
    return part_trials(spark, sf).withColumnRenamed("task_id", "restart")


@query("restart_best", f"WITH {ORACLE_PART_TRIALS} SELECT task_id AS restart, iter, f1 FROM part_trials WHERE f1 = (SELECT min(f1) FROM part_trials)")
def restart_best(spark, sf):
    t = _restarts(spark, sf)
    best = t.groupBy("restart").agg(F.min("f1").alias("m")).agg(F.min("m").alias("best"))
    return H.with_group_stats(t, ["restart"], __m=F.min("f1")).filter(F.col("f1") == best.scalar()).select("restart", "iter", "f1")


@query("restart_configs", f"WITH {ORACLE_PART_TRIALS} SELECT DISTINCT task_id AS restart, size, kind FROM part_trials")
def restart_configs(spark, sf):
    return _restarts(spark, sf).select("restart", "size", "kind").distinct()


@query("restart_pareto", f"""WITH {ORACLE_PART_TRIALS}, d AS (SELECT DISTINCT f1, f2 FROM part_trials)
SELECT f1, f2 FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f1 < a.f1 OR b.f2 < a.f2))""")
def restart_pareto(spark, sf):
    per = P.pareto_front_distinct(_restarts(spark, sf), ["restart"], OBJ)
    return P.pareto_front_distinct(per.select("iter", "f1", "f2"), [], OBJ).select("f1", "f2")


@query("exclude_seen", T + """SELECT DISTINCT quantity, discount, tax, status FROM trials t WHERE task_id = 'A' AND NOT EXISTS (
SELECT 1 FROM trials s WHERE s.task_id = 'R' AND s.quantity = t.quantity AND s.discount = t.discount AND s.tax = t.tax AND s.status = t.status)""")
def exclude_seen(spark, sf):
    t = trials(spark, sf, False)
    return H.exclude_seen(t.filter("task_id = 'A'").select(*CONFIG).distinct(), t.filter("task_id = 'R'"), CONFIG)


@query("nearest_evaluated", """WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
d AS (SELECT c.vec_id, min(sqrt((c.a-e.a)*(c.a-e.a)+(c.b-e.b)*(c.b-e.b)+(c.c-e.c)*(c.c-e.c))) AS distance
 FROM v c, v e WHERE c.label >= 5 AND e.label < 5 GROUP BY 1)
SELECT vec_id, round(distance, 6) AS distance, distance <= 1e-8 AS seen FROM d""")
def nearest_evaluated(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("abc")])
    d = nearest_distance(v.filter("label >= 5"), v.filter("label < 5"), "vec_id", ["a", "b", "c"])
    return d.select("vec_id", r("distance").alias("distance"), (F.col("distance") <= 1e-8).alias("seen"))


@query("first_n_trials", T + "SELECT task_id, iter, f1 FROM trials WHERE iter <= 50")
def first_n_trials(spark, sf):
    return H.first_n_trials(trials(spark, sf), 50).select("task_id", "iter", "f1")


@query("nearest_evaluated_wide", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.label >= 5 AND b.label < 5)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance) AS INTEGER) AS rank, round(distance, 6) AS distance FROM d QUALIFY rank <= 3""")
def nearest_evaluated_wide(spark, sf):
    """The three closest evaluated vectors over all dimensions."""
    e = table(spark, sf, "embeddings")
    near = nearest_vectors(e.filter("label >= 5"), e.filter("label < 5"), "vec_id", "embedding", 3)
    return near.select("vec_id", "rank", r("distance").alias("distance"))
