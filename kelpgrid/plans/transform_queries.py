"""Registered queries: column transforms, designs, metric series."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kelpgrid.functions.expressions import bilog, is_number, r
from kelpgrid.functions.ordering import attach_row
from kelpgrid.operators import design as D
from kelpgrid.operators import metrics as M
from kelpgrid.operators import transforms as X
from kelpgrid.operators.trials import incumbents
from kelpgrid.plans.fixtures import ORACLE_PART_TRIALS, ORACLE_TRIALS, cdf_sql, part_trials, quantile_sql, table, trials, unit_sql
from kelpgrid.plans.registry import query
from kelpgrid.plans.source_queries import CATALOG_SQL, RUNS_SQL, catalog_docs, runs
from kelpgrid.sources.history import load_knob_catalog

T = f"WITH {ORACLE_TRIALS} "
PT = f"WITH {ORACLE_PART_TRIALS} "


@query("scale_01", T + "SELECT task_id, iter, round((f1 - min(f1) OVER w) / (max(f1) OVER w - min(f1) OVER w), 6) AS f1_s FROM trials WINDOW w AS (PARTITION BY task_id)")
def scale_01(spark, sf):
    return X.with_scaled(trials(spark, sf), ["f1"], ["task_id"]).select("task_id", "iter", r("f1_s").alias("f1_s"))


@query("unscale_01", "SELECT p_partkey, round(900 + (2000 - 900) * (p_size / 50.0::DOUBLE), 6) AS price FROM part")
def unscale_01(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r(X.unscale_01(F.col("p_size") / F.lit(50.0), F.lit(900.0), F.lit(2000.0))).alias("price"))


@query("scale_pm1", T + "SELECT task_id, iter, round((f1 - min(f1) OVER w) / (max(f1) OVER w - min(f1) OVER w) * 2 - 1, 6) + 0.0 AS v FROM trials WINDOW w AS (PARTITION BY task_id)")
def scale_pm1(spark, sf):
    return X.with_scaled(trials(spark, sf), ["f1"], ["task_id"]).select("task_id", "iter", r(X.scale_pm1(F.col("f1_s"))).alias("v"))


@query("zscore", T + "SELECT task_id, iter, round((f1 - avg(f1) OVER w) / (stddev_pop(f1) OVER w + 1e-4), 6) + 0.0 AS z FROM trials WINDOW w AS (PARTITION BY task_id)")
def zscore(spark, sf):
    return X.with_zscore(trials(spark, sf), "f1", ["task_id"]).select("task_id", "iter", r("z").alias("z"))


@query("unzscore", T + "SELECT task_id, iter, round(f1, 4) AS f1 FROM trials")
def unzscore(spark, sf):
    z = X.with_zscore(trials(spark, sf), "f1", ["task_id"], keep_stats=True)
    return z.select("task_id", "iter", r(F.col("z") * F.col("z_std") + F.col("z_mean"), 4).alias("f1"))


@query("zscore_guard", """SELECT p_partkey AS iter, p_size AS task_id, round(CASE WHEN min(v) OVER w = max(v) OVER w AND p_partkey = min(p_partkey) OVER w THEN v + 1e-4 ELSE v END, 6) AS v
FROM (SELECT *, CASE WHEN p_size > 10 THEN 1.0::DOUBLE ELSE p_retailprice END AS v FROM part) WINDOW w AS (PARTITION BY p_size)""")
def zscore_guard(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("iter"), F.col("p_size").alias("task_id"),
                                        F.when(F.col("p_size") > 10, 1.0).otherwise(F.col("p_retailprice")).alias("v"))
    return X.zscore_guard(p, "v", ["task_id"], "iter").withColumn("v", r("v"))


@query("bilog", T + "SELECT task_id, iter, round(sign(f2) * ln(1 + abs(f2)), 6) AS v FROM trials")
def bilog_query(spark, sf):
    return trials(spark, sf).select("task_id", "iter", r(bilog("f2")).alias("v"))


RANK_SQL = PT + """, k AS (SELECT task_id, iter, row_number() OVER (PARTITION BY task_id ORDER BY f1, iter) AS rn, count(*) OVER (PARTITION BY task_id) AS n FROM part_trials),
d AS (SELECT *, 1 / (4 * pow(n, 0.25) * sqrt(pi() * ln(n))) AS delta FROM k), cl AS (SELECT task_id, iter, least(greatest((rn - 1) / (n - 1), delta), 1 - delta) AS c FROM d)
"""


@query("gaussian_rank", RANK_SQL + f"SELECT task_id, iter, round({quantile_sql('c')}, 6) + 0.0 AS g FROM cl")
def gaussian_rank(spark, sf):
    return X.gaussian_rank(part_trials(spark, sf), "f1", ["task_id"], "iter").select("task_id", "iter", r("g").alias("g"))


@query("clipped_rank", RANK_SQL + "SELECT task_id, iter, round(c, 6) AS clipped FROM cl")
def clipped_rank(spark, sf):
    return X.gaussian_rank(part_trials(spark, sf), "f1", ["task_id"], "iter").select("task_id", "iter", r("clipped").alias("clipped"))


@query("decile_bin", """WITH d AS (SELECT quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM lineitem)
SELECT bin, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM (SELECT l_extendedprice, len(list_filter(q, lambda x: x < l_extendedprice)) + 1 AS bin FROM lineitem, d)
GROUP BY 1""")
def decile_bin(spark, sf):
    li = table(spark, sf, "lineitem").select("l_extendedprice")
    b = attach_row(li, X.decile_points(li, "l_extendedprice")).withColumn("bin", X.decile_bin(F.col("l_extendedprice"), 1).cast("long"))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("strip_unit", "SELECT p_partkey AS run_id, p_size::DOUBLE AS memory FROM part")
def strip_unit(spark, sf):
    return runs(spark, sf).select("run_id", X.strip_unit("memory").alias("memory"))


@query("add_unit", "SELECT p_partkey, CAST(p_size AS VARCHAR) || 'm' AS memory FROM part")
def add_unit(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.add_unit("p_size", "m").alias("memory"))


@query("bool_flag", f"WITH {RUNS_SQL} SELECT run_id, CASE WHEN compress = 'True' THEN 1 ELSE 0 END AS compress FROM runs")
def bool_flag(spark, sf):
    return runs(spark, sf).select("run_id", X.bool_flag("compress").alias("compress"))




@query("one_hot", f"SELECT run_id, codec_code FROM (WITH {RUNS_SQL} SELECT run_id, (SELECT count(DISTINCT p_type) FROM part p2 WHERE p2.p_type <= codec) AS codec_code FROM runs)")
def one_hot(spark, sf):
    """The 0/1 columns are checked by the position of the single 1."""
    t = runs(spark, sf).select("run_id", "codec")
    values = X.levels(t, "codec")
    hot = X.one_hot(t, "codec", values)
    code = sum((F.col(f"codec_{v}") * (i + 1) for i, v in enumerate(values)), F.lit(0.0))
    return hot.select("run_id", code.cast("long").alias("codec_code"))


@query("coerce_result", f"WITH {RUNS_SQL} SELECT run_id, CAST(trunc(try_cast(result AS DOUBLE)) AS BIGINT) AS result FROM runs WHERE try_cast(result AS DOUBLE) IS NOT NULL")
def coerce_result(spark, sf):
    return X.coerce_result(runs(spark, sf)).select("run_id", "result")


@query("is_numeric", "SELECT event_id, v, try_cast(v AS DOUBLE) IS NOT NULL AS numeric FROM (SELECT event_id, CASE WHEN user_id > 50 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS v FROM events)")
def is_numeric(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("user_id") > 50, F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("v"))
    return e.withColumn("numeric", is_number("v"))


@query("prepare_runs", f"""WITH {RUNS_SQL} SELECT run_id, CAST(regexp_replace(memory, 'g$', '') AS DOUBLE) AS memory, CASE WHEN compress = 'True' THEN 1 ELSE 0 END AS compress,
CAST(trunc(try_cast(result AS DOUBLE)) AS BIGINT) AS result, CAST((SELECT count(DISTINCT p_type) FROM part WHERE p_type <= codec) AS BIGINT) AS code FROM runs WHERE try_cast(result AS DOUBLE) IS NOT NULL""")
def prepare_runs(spark, sf):
    t = X.prepare_runs(runs(spark, sf), ["memory"], ["compress"], "codec")
    hot = sorted(c for c in t.columns if c.startswith("codec_"))
    code = sum((F.col(f"`{c}`") * (i + 1) for i, c in enumerate(hot)), F.lit(0.0))
    return t.select("run_id", "memory", "compress", "result", code.cast("long").alias("code"))


@query("impute_mean_minmax", """WITH k AS (SELECT avg(l_quantity) AS mq, min(l_quantity) AS q0, max(l_quantity) AS q1, avg(l_tax) AS mt, min(l_tax) AS t0, max(l_tax) AS t1 FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey, l_partkey, l_linenumber, round(least(1, greatest(0, (coalesce(nullif(l_quantity, 50) * 1.1, mq) - q0) / (q1 - q0))), 6) AS q, round(least(1, greatest(0, (l_tax - t0) / (t1 - t0))), 6) AS t
FROM lineitem, k WHERE l_returnflag = 'R'""")
def impute_mean_minmax(spark, sf):
    li = table(spark, sf, "lineitem")
    known = li.filter("l_returnflag <> 'R'").select(F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    new = li.filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_linenumber", (F.nullif("l_quantity", F.lit(50.0)) * 1.1).alias("q"), F.col("l_tax").alias("t"))
    out = X.impute_mean_minmax(known, new, ["q", "t"])
    return out.withColumns({"q": r("q"), "t": r("t")})


@query("impute_nonfinite", "SELECT c_custkey, CASE WHEN c_nationkey IN (0, 1, 2) THEN 0.5 ELSE c_acctbal END AS v FROM customer")
def impute_nonfinite(spark, sf):
    n = F.col("c_nationkey")
    v = F.when(n == 0, float("nan")).when(n == 1, float("inf")).when(n == 2, F.lit(None)).otherwise(F.col("c_acctbal"))
    return X.impute_nonfinite(table(spark, sf, "customer").select("c_custkey", v.alias("v")), {"v": 0.5})


@query("impute_from_incumbent", PT + """, b AS (SELECT size, kind FROM part_trials ORDER BY f1, iter LIMIT 1)
SELECT iter, coalesce(nullif(t.size, 7), b.size) AS size, coalesce(nullif(t.kind, 'PROMO'), b.kind) AS kind FROM part_trials t, b""")
def impute_from_incumbent(spark, sf):
    t = part_trials(spark, sf)
    best = t.agg(F.min_by(F.struct("size", "kind"), F.struct("f1", "iter")).alias("b")).select("b.size", "b.kind")
    gaps = t.withColumns({"size": F.nullif("size", F.lit(7)), "kind": F.nullif("kind", F.lit("PROMO"))})
    return X.impute_from_incumbent(gaps, best, ["size", "kind"]).select("iter", "size", "kind")


@query("clip_to_space", "SELECT p_partkey AS iter, CAST(least(40, greatest(10, p_size)) AS INTEGER) AS size, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type ELSE 'ECONOMY' END AS kind FROM part")
def clip_to_space(spark, sf):
    return X.clip_to_space(part_trials(spark, sf), {"size": (10, 40)}, {"kind": (["ECONOMY", "PROMO"], "ECONOMY")}, ["iter"])


@query("configs_to_table", "SELECT p_partkey AS iter, CAST(p_size AS VARCHAR) AS size, p_type AS kind FROM part")
def configs_to_table(spark, sf):
    t = part_trials(spark, sf).withColumn("m", F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("kind"), F.col("kind")))
    return X.configs_to_table(t, "m", ["size", "kind"], ["iter"])


@query("active_params", "SELECT p_partkey AS iter, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_size END AS size, p_type AS kind FROM part")
def active_params(spark, sf):
    return X.active_params(part_trials(spark, sf), [("size", "kind", ["ECONOMY", "PROMO"])]).select("iter", "size", "kind")


@query("forbidden_filter", "SELECT p_partkey AS iter FROM part WHERE NOT (p_size = 7 OR (p_type IN ('ECONOMY', 'PROMO') AND p_size IN (1, 2, 3)))")
def forbidden_filter(spark, sf):
    return X.forbidden_filter(part_trials(spark, sf), [[("size", [7])], [("kind", ["ECONOMY", "PROMO"]), ("size", [1, 2, 3])]]).select("iter")


@query("drop_metrics", """SELECT vec_id, 51 AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) - embedding[12] - embedding[13] - embedding[16] - embedding[38] - embedding[41] - embedding[44]
 - embedding[48] - embedding[49] - embedding[50] - embedding[51] - embedding[52] - embedding[63] - embedding[64], 4) + 0.0 AS total FROM embeddings""")
def drop_metrics(spark, sf):
    e = table(spark, sf, "embeddings")
    wide = F.array_append(F.transform("embedding", lambda x: x.cast("double")), F.col("label").cast("double"))
    t = e.select("vec_id", X.drop_metrics(wide).alias("m"))
    return t.select("vec_id", F.size("m").alias("width"), r(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _catalog(spark, sf):
    return load_knob_catalog(catalog_docs(spark, sf))


@query("param_bounds", f"""WITH {CATALOG_SQL} SELECT name, CASE WHEN type = 'enum' THEN CAST(len(choices) AS INTEGER) ELSE 0 END AS code, CASE WHEN type = 'enum' THEN len(choices)::DOUBLE ELSE 0 END AS low,
CASE WHEN type <> 'enum' THEN 1.0::DOUBLE END AS high FROM cat""")
def param_bounds(spark, sf):
    return X.param_bounds(_catalog(spark, sf))


@query("space_size", f"""WITH {CATALOG_SQL} SELECT space, round(sum(log10(CASE WHEN type = 'enum' THEN len(choices)::DOUBLE WHEN max - min > 10000 AND type = 'integer' THEN greatest(1, (max - min + 1) / (max - min) * 10000) END)), 6) AS log10_size
FROM cat GROUP BY 1""")
def space_size(spark, sf):
    return X.space_size(_catalog(spark, sf), ["space"]).withColumn("log10_size", r("log10_size"))


@query("space_features", f"WITH {CATALOG_SQL} SELECT space, count(*) AS knobs, avg((type <> 'enum')::INT) AS numeric_share, avg((type = 'enum')::INT) AS categorical_share FROM cat GROUP BY 1")
def space_features(spark, sf):
    return X.space_features(_catalog(spark, sf), ["space"])


# Metric series

@query("metric_series", "SELECT event_type AS metric, time_bucket(INTERVAL 6 HOUR, ts) AS start, round(avg(value), 6) AS mean, max(value) AS high, count(*) AS n FROM events GROUP BY ALL")
def metric_series(spark, sf):
    return M.metric_series(metric_log(spark, sf), "6 hours").withColumns({"mean": r("mean"), "start": F.col("start").cast("timestamp_ntz")})


@query("counter_delta", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id), 6) + 0.0 AS delta FROM events")
def counter_delta(spark, sf):
    log = metric_log(spark, sf).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return M.counter_delta(log, ["us", "event_id"]).select("event_id", r("delta").alias("delta"))


@query("ratio_series", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, round(100.0 * sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) / sum(value), 6) AS percent FROM events GROUP BY 1")
def ratio_series(spark, sf):
    return M.ratio_series(metric_log(spark, sf), "1 day", "error").select(F.col("start").cast("timestamp_ntz").alias("start"), r("percent").alias("percent"))


def metric_log(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value")


# Designs

def space(spark, sf):
    """Numeric and categorical knobs with the bounds found in lineitem (one row on the driver)."""
    b = table(spark, sf, "lineitem").agg(F.min("l_quantity").alias("q0"), F.max("l_quantity").alias("q1"), F.min("l_tax").alias("t0"), F.max("l_tax").alias("t1")).first()
    return [{"name": "quantity", "type": "integer", "low": b["q0"], "high": b["q1"]}, {"name": "tax", "type": "float", "low": b["t0"], "high": b["t1"]}]


def _base(spark, sf):
    """One candidate per supplier."""
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row"))


KNOB_SQL = "b AS (SELECT min(l_quantity)::BIGINT AS q0, max(l_quantity)::BIGINT AS q1, min(l_tax) AS t0, max(l_tax) AS t1 FROM lineitem)"


def _draw_sql(seed: str, i: int) -> str:
    return unit_sql("CAST(s_suppkey AS VARCHAR)", f"{seed} || ':{i}'")


@query("random_design", f"""WITH {KNOB_SQL} SELECT s_suppkey AS "row", q0 + CAST(floor({_draw_sql("'7'", 0)} * (q1 - q0 + 1)) AS BIGINT) AS quantity,
round(t0 + {_draw_sql("'7'", 1)} * (t1 - t0), 6) AS tax, CASE WHEN {_draw_sql("'7'", 2)} < 0.5 THEN 'on' ELSE 'off' END AS mode FROM supplier, b""")
def random_design(spark, sf):
    s = space(spark, sf) + [{"name": "mode", "type": "enum", "choices": ["on", "off"]}]
    return D.random_design(_base(spark, sf), s, seed=7).withColumn("tax", r("tax"))


@query("random_design_distinct", f"""WITH {KNOB_SQL}, t AS (SELECT unnest(range(0, 30)) AS t),
dr AS (SELECT t, q0 + CAST(floor({_draw_sql("(7 + 1000 * t)::VARCHAR", 0)} * (q1 - q0 + 1)) AS BIGINT) AS quantity, CASE WHEN {_draw_sql("(7 + 1000 * t)::VARCHAR", 1)} < 0.5 THEN 'on' ELSE 'off' END AS mode FROM supplier, b, t),
fi AS (SELECT quantity, mode, min(t) AS t FROM dr WHERE NOT (mode = 'on' AND quantity IN (SELECT l_quantity FROM lineitem WHERE l_quantity < 5)) GROUP BY ALL),
st AS (SELECT min(t) AS t FROM (SELECT t, sum(count(*)) OVER (ORDER BY t) AS n FROM fi GROUP BY t) WHERE n >= 40)
SELECT quantity, mode FROM fi WHERE t <= (SELECT t FROM st) ORDER BY md5(quantity || ':' || mode), quantity, mode LIMIT 40""")
def random_design_distinct(spark, sf):
    s = space(spark, sf)[:1] + [{"name": "mode", "type": "enum", "choices": ["on", "off"]}]
    seen = table(spark, sf, "lineitem").filter("l_quantity < 5").select(F.col("l_quantity").cast("long").alias("quantity"), F.lit("on").alias("mode")).distinct()
    return D.random_design_distinct(_base(spark, sf), s, seen, 40, seed=7)


@query("lhs_design", f"""WITH s AS (SELECT s_suppkey AS k, d, i, {unit_sql("CAST(s_suppkey AS VARCHAR)", "'5:' || d || ':r' || i")} AS r, {unit_sql("CAST(s_suppkey AS VARCHAR)", "'5:' || d || ':j' || i")} AS j
 FROM supplier, (SELECT unnest(range(0, 4)) AS d), (SELECT unnest(range(0, 3)) AS i)),
u AS (SELECT k, d, i, (row_number() OVER (PARTITION BY d, i ORDER BY r, k) - j) / count(*) OVER (PARTITION BY d, i) AS u FROM s),
w AS (SELECT d, k, max(u) FILTER (i = 0) AS u0, max(u) FILTER (i = 1) AS u1, max(u) FILTER (i = 2) AS u2 FROM u GROUP BY ALL),
sc AS (SELECT d, greatest(abs(corr(u0, u1)), abs(corr(u0, u2)), abs(corr(u1, u2))) AS c FROM w GROUP BY 1)
SELECT k AS "row", round(u0, 6) AS u0, round(u1, 6) AS u1, round(u2, 6) AS u2 FROM w WHERE d = (SELECT min_by(d, c) FROM sc)""")
def lhs_design(spark, sf):
    return D.lhs_design(_base(spark, sf), 3, seed=5, criterion="correlation").withColumns({u: r(u) for u in ("u0", "u1", "u2")})


def _sobol_sql(dims: int, seed: int | None = None) -> str:
    """The direction numbers of the set bits of the Gray code and the shift of the dimension, joined by xor."""
    shift = random.Random(seed)

    def point(d: int) -> str:
        out = f"{shift.getrandbits(D.SOBOL_BITS) if seed is not None else 0}::BIGINT"
        for x in [f"((g >> {b}) & 1) * {v}" for b, v in enumerate(D._directions(d)[:20])]:
            out = f"xor({out}, {x})"
        return f"({out}) / 1073741824.0::DOUBLE AS u{d}"

    return f"""WITH n AS (SELECT s_suppkey AS "row", row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier),
c AS (SELECT "row", xor(i, i >> 1) AS g FROM n) SELECT "row", {', '.join(map(point, range(dims)))} FROM c"""


@query("sobol_design", _sobol_sql(4, 11))
def sobol_design(spark, sf):
    return D.sobol_design(_base(spark, sf), 4, seed=11)


@query("sobol_design_40", _sobol_sql(40))
def sobol_design_40(spark, sf):
    return D.sobol_design(_base(spark, sf), 40, seed=None)


UNIT = """v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)"""


def unit_vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("abc")])


@query("bounded_design", f"WITH {UNIT} SELECT vec_id, round(10 + a * 20, 6) AS a, round(-1 + b * 2, 6) + 0.0 AS b FROM v")
def bounded_design(spark, sf):
    out = D.bounded_design(unit_vectors(spark, sf), {"a": (10.0, 30.0), "b": (-1.0, 1.0)}, ["vec_id"])
    return out.withColumns({"a": r("a"), "b": r("b")})


@query("farthest_first", f"""WITH RECURSIVE {UNIT}, s(pick, id, near, ids) AS (
 SELECT 0, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), []::BIGINT[]
 UNION ALL SELECT * FROM (SELECT s.pick + 1, v.vec_id, least(sqrt(v.a*v.a+v.b*v.b+v.c*v.c), coalesce((SELECT min(sqrt((v.a-p.a)*(v.a-p.a)+(v.b-p.b)*(v.b-p.b)+(v.c-p.c)*(v.c-p.c))) FROM v p WHERE list_contains(s.ids, p.vec_id)), 1e9)) AS near,
  list_append(s.ids, v.vec_id) FROM s, v WHERE s.pick < 5 ORDER BY near DESC, v.vec_id LIMIT 1))
SELECT pick, id AS vec_id, round(near, 6) AS distance FROM s WHERE pick > 0""")
def farthest_first(spark, sf):
    return D.farthest_first(unit_vectors(spark, sf), "vec_id", ["a", "b", "c"], {"a": 0.0, "b": 0.0, "c": 0.0}, 5).withColumn("distance", r("distance"))


@query("initial_design")
def initial_design(spark, sf):
    return D.initial_design(_base(spark, sf), space(spark, sf), {"quantity": 25, "tax": 0.04}, "explore_first", 7, 6)


PRED = "pr AS (SELECT vec_id, label, embedding[1]::DOUBLE AS mu, sqrt(abs(embedding[9]::DOUBLE)) AS sigma FROM embeddings)"


def predictions(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("mu"), F.sqrt(F.abs(F.col("embedding")[8].cast("double"))).alias("sigma"))


@query("score_lcb", f"WITH {PRED} SELECT vec_id, round(mu - 1.96 * sigma, 6) + 0.0 AS score FROM pr")
def score_lcb(spark, sf):
    return predictions(spark, sf).select("vec_id", r(D.score_lcb("mu", "sigma")).alias("score"))


def _scored(spark, sf, fn):
    p = predictions(spark, sf)
    return p.withColumn("best", p.agg(F.min("mu")).scalar()).select("vec_id", r(fn("mu", "sigma", F.col("best"))).alias("score"))


SCORE_SQL = f"WITH {PRED}, g AS (SELECT vec_id, sigma, (SELECT min(mu) FROM pr) - 0.01 - mu AS gain FROM pr), z AS (SELECT *, gain / nullif(sigma, 0) AS z FROM g)"


@query("score_ei", SCORE_SQL + f"SELECT vec_id, round(CASE WHEN sigma > 0 THEN -(gain * {cdf_sql('z')} + sigma * exp(-z * z / 2) / sqrt(2 * pi())) ELSE 0 END, 6) + 0.0 AS score FROM z")
def score_ei(spark, sf):
    return _scored(spark, sf, D.score_ei)


@query("score_pi", SCORE_SQL + f"SELECT vec_id, round(CASE WHEN sigma > 0 THEN -{cdf_sql('z')} ELSE 0 END, 6) + 0.0 AS score FROM z")
def score_pi(spark, sf):
    return _scored(spark, sf, D.score_pi)


@query("top_candidates", f"WITH {PRED} SELECT vec_id, round(mu - 1.96 * sigma, 6) AS score FROM pr ORDER BY mu - 1.96 * sigma, vec_id LIMIT 20")
def top_candidates(spark, sf):
    s = predictions(spark, sf).select("vec_id", D.score_lcb("mu", "sigma").alias("score"))
    return D.top_candidates(s, "score", "vec_id", 20).withColumn("score", r("score"))


@query("hedge_weights", f"""WITH {PRED}, g AS (SELECT label AS acq, sum(-mu) AS gain FROM pr GROUP BY 1), e AS (SELECT acq, exp(gain - max(gain) OVER ()) AS e FROM g)
SELECT acq, round(e / sum(e) OVER (), 6) AS weight FROM e""")
def hedge_weights(spark, sf):
    return D.hedge_weights(predictions(spark, sf).select(F.col("label").alias("acq"), "mu")).withColumn("weight", r("weight"))


@query("fit_regressor")
def fit_regressor(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("result"), (F.length("p_type")).alias("kind_len"))
    return D.fit_regressor(p, ["p_size", "kind_len"], "result").select("p_partkey", "prediction")


@query("source_incumbents", PT + """SELECT task_id, iter, size, kind, f1 FROM (SELECT *, rank() OVER (PARTITION BY task_id ORDER BY f1) AS k FROM
(SELECT task_id, size, kind, min(iter) AS iter, min_by(f1, iter) AS f1 FROM part_trials GROUP BY ALL)) WHERE k = 1""")
def source_incumbents(spark, sf):
    return incumbents(part_trials(spark, sf).select("task_id", "iter", "size", "kind", "f1"), "f1", ["size", "kind"])


