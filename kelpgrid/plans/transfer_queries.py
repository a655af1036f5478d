"""Registered queries: pairs and ranking, transfer, importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpgrid.functions.expressions import r
from kelpgrid.operators import importance as I
from kelpgrid.operators import pairs as P
from kelpgrid.operators import transfer as X
from kelpgrid.operators import trials as H
from kelpgrid.plans.fixtures import ORACLE_PART_TRIALS, ORACLE_TRIALS, part_trials, quantile_sql, table, trials, unit_sql
from kelpgrid.plans.registry import query
from kelpgrid.session import materialize

MODELS = [1, 2, 3, 4]
# Pairwise ranking of suppliers (as runs) and parts.


@query("all_pairs", """SELECT a.s_suppkey, count(b.s_suppkey) AS pairs, count(*) FILTER (a.s_acctbal > b.s_acctbal) AS greater,
round(coalesce(sum(CASE WHEN a.s_acctbal > b.s_acctbal THEN b.s_acctbal END), 0), 2) + 0.0 AS greater_sum
FROM supplier a LEFT JOIN supplier b ON a.s_suppkey < b.s_suppkey GROUP BY 1""")
def all_pairs(spark, sf):
    """Every unordered pair i < j, summed up per first row."""
    return P.all_pairs(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal").withColumn("greater_sum", r("greater_sum", 2))


def _runs(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"),
                                           F.length("p_name").cast("double").alias("width"), F.col("p_retailprice").alias("result"))


FEATURES = ["size", "width"]
SIDES = ["size_1", "width_1", "size_2", "width_2"]
HASH = "CAST('0x' || substr(md5(CAST({k} AS VARCHAR) || ':42'), 1, 12) AS BIGINT)"
PAIRS_SQL = f"""WITH rn AS (SELECT p_partkey AS id, p_size::DOUBLE AS size, length(p_name)::DOUBLE AS width, p_retailprice AS result,
 row_number() OVER (ORDER BY {HASH.format(k='p_partkey')}, p_partkey) AS rn FROM part),
dp AS (SELECT (a.rn - 1) // 2 AS pair, a.id AS id_1, a.size AS size_1, a.width AS width_1, b.id AS id_2, b.size AS size_2, b.width AS width_2,
 CASE WHEN a.result < b.result THEN 1 ELSE 0 END AS label FROM rn a JOIN rn b ON b.rn = a.rn + 1 WHERE a.rn % 2 = 1),
tt AS (SELECT *, {HASH.format(k='pair')} < CAST(0.8 * 281474976710656 AS BIGINT) AS is_train FROM dp)
"""


def _pairs(spark, sf):
    return P.disjoint_pairs(_runs(spark, sf), "id", FEATURES, "result")


@query("disjoint_pairs", PAIRS_SQL + "SELECT * FROM dp")
def disjoint_pairs(spark, sf):
    return _pairs(spark, sf)


@query("train_test", PAIRS_SQL + "SELECT pair, is_train FROM tt")
def train_test(spark, sf):
    return P.train_test(_pairs(spark, sf), "pair").select("pair", "is_train")


def _classifier(kind):
    def run(spark, sf):
        return P.fit_pair_classifier(_pairs(spark, sf), SIDES, kind)
    return run


for _kind in ("lr", "svm", "dt", "rf", "nb", "nn", "gbt"):
    query(f"fit_pair_{_kind}")(_classifier(_kind))


@query("fit_pair_knn", PAIRS_SQL + """, d AS (SELECT a.pair, a.label, b.label AS vote, row_number() OVER (PARTITION BY a.pair ORDER BY
 sqrt((a.size_1-b.size_1)*(a.size_1-b.size_1)+(a.width_1-b.width_1)*(a.width_1-b.width_1)+(a.size_2-b.size_2)*(a.size_2-b.size_2)+(a.width_2-b.width_2)*(a.width_2-b.width_2)), b.pair) AS k
 FROM tt a, tt b WHERE NOT a.is_train AND b.is_train)
SELECT pair, label, CASE WHEN avg(vote) > 0.5 THEN 1 ELSE 0 END AS prediction FROM d WHERE k <= 5 GROUP BY ALL""")
def fit_pair_knn(spark, sf):
    return P.fit_pair_knn(_pairs(spark, sf), SIDES)


@query("fit_rank")
def fit_rank(spark, sf):
    return P.fit_rank(_pairs(spark, sf), _runs(spark, sf), "id", FEATURES)


@query("fit_siamese")
def fit_siamese(spark, sf):
    return P.fit_siamese(_pairs(spark, sf), FEATURES)


@query("pair_metrics", PAIRS_SQL + """, c AS (SELECT count(*) FILTER (label = 1 AND size_1 < size_2) AS tp, count(*) FILTER (label = 0 AND size_1 < size_2) AS fp,
 count(*) FILTER (label = 1 AND size_1 >= size_2) AS fn, count(*) FILTER (label = 0 AND size_1 >= size_2) AS tn FROM dp)
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def pair_metrics(spark, sf):
    p = _pairs(spark, sf).withColumn("prediction", (F.col("size_1") < F.col("size_2")).cast("int"))
    m = P.pair_metrics(p)
    return m.select(*[r(c).alias(c) for c in m.columns])


@query("ndcg", """WITH k AS (SELECT p_brand AS task_id, p_size AS y, p_retailprice AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn,
 row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS ri FROM part),
t AS (SELECT task_id, s, avg(y) * sum(1 / log2(rn + 1)) AS dcg, sum(y / log2(ri + 1)) AS ideal FROM k GROUP BY ALL)
SELECT task_id, round(sum(dcg) / sum(ideal), 6) AS ndcg FROM t GROUP BY 1""")
def ndcg(spark, sf):
    t = part_trials(spark, sf)
    return P.ndcg(t, ["task_id"], "iter", "size", "f1").withColumn("ndcg", r("ndcg"))


@query("tournament_best", """WITH d AS (SELECT CASE WHEN a.s_acctbal > b.s_acctbal THEN b.s_suppkey ELSE a.s_suppkey END AS id FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey),
w AS (SELECT s_suppkey, (SELECT count(*) FROM d WHERE d.id = s.s_suppkey) AS wins FROM supplier s)
SELECT s_suppkey, wins, s_suppkey = (SELECT min(s_suppkey) FROM w WHERE wins = (SELECT max(wins) FROM w)) AS best FROM w""")
def tournament_best(spark, sf):
    return P.tournament_best(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal")


@query("tournament_wins", PAIRS_SQL + "SELECT CASE WHEN size_1 > size_2 THEN id_2 ELSE id_1 END AS id, count(*) AS wins FROM dp GROUP BY 1")
def tournament_wins(spark, sf):
    p = _pairs(spark, sf).select(F.col("id_1").alias("first"), F.col("id_2").alias("second"), (F.col("size_1") > F.col("size_2")).cast("int").alias("prediction"))
    return P.tournament_wins(p)


# Transfer: embeddings as predictions of four models per task (label)

LONG_SQL = """WITH e AS (SELECT vec_id, label AS task, embedding FROM embeddings),
lg AS (SELECT vec_id, task, m AS model, embedding[1]::DOUBLE AS y, embedding[m + 1]::DOUBLE AS mu, abs(embedding[m + 9]::DOUBLE) AS var FROM e, (SELECT unnest([1,2,3,4]) AS m))
"""


def long_predictions(spark, sf):
    e = table(spark, sf, "embeddings")
    e = e.select("vec_id", F.col("label").alias("task"), "embedding", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))
    return e.select("vec_id", "task", "model", F.col("embedding")[0].cast("double").alias("y"), F.get("embedding", F.col("model")).cast("double").alias("mu"),
                    F.abs(F.get("embedding", F.col("model") + 8).cast("double")).alias("var"))


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("task_id"), F.col("embedding")[0].cast("double").alias("y"),
                    *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in MODELS])


XS = [f"x{i}" for i in MODELS]


@query("fit_per_task")
def fit_per_task(spark, sf):
    return X.fit_per_task(_vectors(spark, sf), XS, "y")


@query("fit_per_task_first", """WITH f AS (SELECT label, embedding[1]::DOUBLE AS y, embedding[2]::DOUBLE AS x FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 20)
SELECT CAST(label AS VARCHAR) AS task_id, round(avg(y), 6) AS y_mean, round(regr_slope(y, x) * count(*) / (count(*) + 0.001), 6) + 0.0 AS slope FROM f GROUP BY 1""")
def fit_per_task_first(spark, sf):
    """Models of the first 20 runs of each task on one feature."""
    m = X.fit_per_task(_vectors(spark, sf), ["x1"], "y", first_n=20, order=["vec_id"])
    return m.select("task_id", r("y_mean").alias("y_mean"), r(F.get("coef", 1) * F.col("y_std")).alias("slope"))


@query("fit_residual_chain")
def fit_residual_chain(spark, sf):
    v = _vectors(spark, sf)
    tasks = [t[0] for t in v.select("task_id").distinct().orderBy("task_id").collect()]
    return X.fit_residual_chain(v, XS, "y", tasks)


@query("kfold_assign", f"WITH {ORACLE_PART_TRIALS} SELECT task_id, iter, least(floor((rn - 1) / greatest(n // 5, 1))::BIGINT, 4) AS fold FROM (SELECT task_id, iter, row_number() OVER (PARTITION BY task_id ORDER BY iter) AS rn, count(*) OVER (PARTITION BY task_id) AS n FROM part_trials)")
def kfold_assign(spark, sf):
    return X.kfold_assign(part_trials(spark, sf), ["task_id"], ["iter"]).select("task_id", "iter", F.col("fold").cast("long").alias("fold"))


@query("oof_predictions")
def oof_predictions(spark, sf):
    return X.oof_predictions(_vectors(spark, sf), ["task_id"], ["vec_id"], XS, "y").select("vec_id", "task_id", "fold", "mu", "mu_var")


@query("ranking_loss", LONG_SQL + """SELECT a.task, a.model, count(*) FILTER ((a.y < b.y) <> (a.mu < b.mu)) AS misranked, round(avg(CASE WHEN (a.y < b.y) <> (a.mu < b.mu) THEN 1.0::DOUBLE ELSE 0 END), 6) AS loss
FROM lg a JOIN lg b ON a.task = b.task AND a.model = b.model GROUP BY ALL""")
def ranking_loss(spark, sf):
    return X.ranking_loss(long_predictions(spark, sf), ["task", "model"], "vec_id", "y", "mu").withColumn("loss", r("loss"))


@query("ranking_loss_target", LONG_SQL + """, f AS (SELECT *, (vec_id % 4 + 1)::INTEGER AS fold FROM lg)
SELECT a.task, count(*) FILTER ((a.y < b.y) <> (a.mu < b.mu)) AS misranked, round(avg(CASE WHEN (a.y < b.y) <> (a.mu < b.mu) THEN 1.0::DOUBLE ELSE 0 END), 6) AS loss
FROM f a JOIN f b ON a.task = b.task AND a.model = b.model WHERE a.fold = a.model GROUP BY ALL""")
def ranking_loss_target(spark, sf):
    t = long_predictions(spark, sf).withColumn("fold", (F.col("vec_id") % 4 + 1).cast("int"))
    return X.ranking_loss_target(t, ["task"], "vec_id", "y", "mu", "fold", "model").withColumn("loss", r("loss"))


@query("ranking_loss_no_task", LONG_SQL + """, n AS (SELECT nullif(task, 3) AS task, model, y, mu FROM lg)
SELECT a.task, a.model, count(*) FILTER ((a.y < b.y) <> (a.mu < b.mu)) AS misranked, round(avg(CASE WHEN (a.y < b.y) <> (a.mu < b.mu) THEN 1.0::DOUBLE ELSE 0 END), 6) AS loss
FROM n a JOIN n b ON a.task IS NOT DISTINCT FROM b.task AND a.model = b.model GROUP BY ALL""")
def ranking_loss_no_task(spark, sf):
    """One task has no name."""
    t = long_predictions(spark, sf).withColumn("task", F.nullif("task", F.lit(3)))
    return X.ranking_loss(t, ["task", "model"], "vec_id", "y", "mu").withColumn("loss", r("loss"))


@query("fold_predictions")
def fold_predictions(spark, sf):
    return X.fold_predictions(_vectors(spark, sf), ["task_id"], ["vec_id"], XS, "y").select("vec_id", "task_id", "fold", "left_out", "mu", "mu_var")


def _sampled(spark, sf):
    return X.ranking_loss_sampled(long_predictions(spark, sf), ["model"], "vec_id", "y", "mu", "var")


SAMPLED_SQL = LONG_SQL + f""", uu AS (SELECT *, {unit_sql("model || ':' || vec_id || ':' || draw", "'1'")} + 0.5e0 / 281474976710656e0 AS u FROM lg, (SELECT CAST(unnest(range(1, 51)) AS INTEGER) AS draw)),
dw AS (SELECT vec_id, model, draw, y, mu + {quantile_sql('u')} * var AS p FROM uu),
ls AS (SELECT a.model, a.draw, count(*) FILTER ((a.y < b.y) <> (a.p < b.p)) AS misranked, avg(CASE WHEN (a.y < b.y) <> (a.p < b.p) THEN 1.0::DOUBLE ELSE 0 END) AS loss
 FROM dw a JOIN dw b ON a.model = b.model AND a.draw = b.draw GROUP BY ALL)
"""


@query("ranking_loss_sampled", SAMPLED_SQL + "SELECT model, draw, misranked, round(loss, 6) AS loss FROM ls")
def ranking_loss_sampled(spark, sf):
    return _sampled(spark, sf).withColumn("loss", r("loss"))


@query("rgpe_weights", SAMPLED_SQL + """, win AS (SELECT draw, min_by(model, misranked * 10 + model) AS model FROM ls GROUP BY 1),
s AS (SELECT model, list_sort(list(misranked)) AS s FROM ls GROUP BY 1),
w AS (SELECT s.model, coalesce(n, 0) / 50 AS w, s.model <> 4 AND s.s[26] > (SELECT s[48] FROM s WHERE model = 4) AS ignored FROM s LEFT JOIN (SELECT model, count(*) AS n FROM win GROUP BY 1) k ON k.model = s.model)
SELECT model, round(CASE WHEN ignored THEN 0 ELSE w END, 6) AS weight, ignored FROM w""")
def rgpe_weights(spark, sf):
    return X.rgpe_weights(materialize(_sampled(spark, sf)), target=4).withColumn("weight", r("weight"))


SHARE_SQL = LONG_SQL + """, sh AS (SELECT a.task, a.model, avg(CASE WHEN (a.y > b.y) = (a.mu > b.mu) THEN 1.0::DOUBLE ELSE 0 END) AS share
 FROM lg a JOIN lg b ON a.task = b.task AND a.model = b.model AND a.vec_id < b.vec_id GROUP BY ALL)
"""


def _shares(spark, sf):
    return X.order_preserving(long_predictions(spark, sf), ["task", "model"], "vec_id", "y", "mu")


@query("order_preserving", SHARE_SQL + "SELECT task, model, round(share, 6) AS share FROM sh")
def order_preserving(spark, sf):
    return _shares(spark, sf).withColumn("share", r("share"))


@query("power_weights", SHARE_SQL + "SELECT task, model, round(share*share*share / sum(share*share*share) OVER (PARTITION BY task), 6) AS weight FROM sh")
def power_weights(spark, sf):
    return X.power_weights(materialize(_shares(spark, sf)), ["task"]).select("task", "model", r("weight").alias("weight"))


@query("fit_fidelity_weights", SHARE_SQL + """SELECT sh.task, model, round(CASE WHEN n >= 5 THEN share*share*share / sum(share*share*share) OVER (PARTITION BY sh.task) ELSE 0.25 END, 6) AS weight
FROM sh JOIN (SELECT task, count(*) AS n FROM e GROUP BY 1) c ON c.task = sh.task""")
def fit_fidelity_weights(spark, sf):
    w = X.fit_fidelity_weights(long_predictions(spark, sf), ["task"], "vec_id", "y", "mu")
    return w.withColumn("weight", r("weight"))


def _blocks(spark, sf):
    e = table(spark, sf, "embeddings")
    v = e.select("vec_id", F.col("label").alias("task"), F.col("embedding")[0].cast("double").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in MODELS])
    return X.pair_blocks(v, ["task"], "vec_id", "y", XS)


W = [0.4, 0.3, 0.2, 0.1]
WIDE_SQL = """WITH v AS (SELECT vec_id, label AS task, embedding[1]::DOUBLE AS y, embedding[2]::DOUBLE AS a1, embedding[3]::DOUBLE AS a2, embedding[4]::DOUBLE AS a3, embedding[5]::DOUBLE AS a4 FROM embeddings),
p AS (SELECT *, 0.4 * a1 + 0.3 * a2 + 0.2 * a3 + 0.1 * a4 AS p FROM v),
pr AS (SELECT i.task, j.p - i.p AS d, j.a1 - i.a1 AS d1, j.a2 - i.a2 AS d2, j.a3 - i.a3 AS d3, j.a4 - i.a4 AS d4 FROM p i JOIN p j ON i.task = j.task AND i.y > j.y)
"""


@query("pair_loss", WIDE_SQL + """SELECT task, 'hinge' AS loss, round(avg(greatest(d, 0)), 6) AS value FROM pr GROUP BY 1 UNION ALL SELECT task, 'exp', round(avg(exp(d)), 6) FROM pr GROUP BY 1
UNION ALL SELECT task, 'log', round(avg(ln(1 + exp(d))), 6) FROM pr GROUP BY 1 UNION ALL SELECT task, 'log10', round(avg(ln(1 + exp(10 * d))), 6) FROM pr GROUP BY 1
UNION ALL SELECT task, 'l2', round(sqrt(sum((y - p) * (y - p))) / count(*), 6) FROM p GROUP BY 1""")
def pair_loss(spark, sf):
    b = _blocks(spark, sf)
    out = None
    for loss in ("hinge", "exp", "log", "log10"):
        one = X.pair_loss(b, ["task"], W, loss)
        out = one if out is None else out.unionByName(one)
    v = _vectors(spark, sf).withColumn("task", F.col("task_id").cast("int"))
    p = sum((F.col(x) * w for x, w in zip(XS, W)), F.lit(0.0))
    l2 = X.l2_loss(v, ["task"], "y", p).select("task", F.lit("l2").alias("loss"), "value")
    return out.unionByName(l2).withColumn("value", r("value"))


@query("pair_loss_gradient", WIDE_SQL + """SELECT task, round(avg(s * d1), 6) + 0.0 AS g0, round(avg(s * d2), 6) + 0.0 AS g1, round(avg(s * d3), 6) + 0.0 AS g2, round(avg(s * d4), 6) + 0.0 AS g3
FROM (SELECT *, exp(d) / (1 + exp(d)) AS s FROM pr) GROUP BY 1""")
def pair_loss_gradient(spark, sf):
    g = X.pair_loss_gradient(_blocks(spark, sf), ["task"], W, "log")
    return g.select("task", *[r(f"g{i}").alias(f"g{i}") for i in range(4)])


@query("simplex_weights")
def simplex_weights(spark, sf):
    w = X.simplex_weights(_vectors(spark, sf), "vec_id", "y", XS, target="x4")
    return spark.createDataFrame(list(w.items()), "model string, weight double")


CW = "(VALUES (1, 0.4), (2, 0.3), (3, 0.2), (4, 0.1)) AS w(model, weight)"


def _weights(spark):
    return spark.createDataFrame(list(zip(MODELS, W)), "model int, weight double")


@query("combine_predictions", LONG_SQL + f""", c AS (SELECT vec_id, model, mu, greatest(var, 1e-10) AS var, weight::DOUBLE AS weight FROM lg JOIN {CW} USING (model))
SELECT 'idp_lc' AS method, vec_id, round(sum(weight * mu), 6) + 0.0 AS mu, round(sum(weight * weight * var), 6) AS var FROM c GROUP BY vec_id
UNION ALL SELECT 'no_var', vec_id, round(sum(weight * mu), 6) + 0.0, round(max(CASE WHEN model = 4 THEN var END), 6) FROM c GROUP BY vec_id
UNION ALL SELECT 'gpoe', vec_id, round(sum(weight * mu / var) / sum(weight / var), 6) + 0.0, round(1 / sum(weight / var), 6) FROM c GROUP BY vec_id""")
def combine_predictions(spark, sf):
    lg, w, out = long_predictions(spark, sf), _weights(spark), None
    for m in ("idp_lc", "no_var", "gpoe"):
        one = X.combine_predictions(lg, w, "vec_id", m, target=4).select(F.lit(m).alias("method"), "vec_id", r("mu").alias("mu"), r("var").alias("var"))
        out = one if out is None else out.unionByName(one)
    return out


@query("stack_predictions", LONG_SQL + """, i AS (SELECT vec_id, sum(mu) AS mu, list(sqrt(greatest(var, 1e-10)) ORDER BY model) AS s FROM lg GROUP BY 1),
b AS (SELECT 0.95 * 20 / (0.95 * 20 + 10) AS b2, 0.95 * 30 / (0.95 * 30 + 20) AS b3, 0.95 * 40 / (0.95 * 40 + 30) AS b4)
SELECT vec_id, round(mu, 6) + 0.0 AS mu, round(pow(s[4], b4) * pow(pow(s[3], b3) * pow(pow(s[2], b2) * pow(s[1], 1 - b2), 1 - b3), 1 - b4), 6) AS sigma FROM i, b""")
def stack_predictions(spark, sf):
    out = X.stack_predictions(long_predictions(spark, sf), "vec_id", {1: 10, 2: 20, 3: 30, 4: 40})
    return out.select("vec_id", r("mu").alias("mu"), r("sigma").alias("sigma"))


@query("variance_floor", LONG_SQL + "SELECT vec_id, model, round(CASE WHEN task = 0 THEN 1e-10 ELSE greatest(var - 0.05, 1e-10) END, 12) AS var FROM lg")
def variance_floor(spark, sf):
    lg = long_predictions(spark, sf)
    v = F.when(F.col("task") == 0, float("nan")).otherwise(F.col("var") - 0.05)
    return lg.select("vec_id", "model", r(X.variance_floor(v), 12).alias("var"))


@query("batch_predict", "SELECT vec_id, embedding[2]::DOUBLE AS m1, embedding[3]::DOUBLE AS m2, embedding[4]::DOUBLE AS m3, embedding[5]::DOUBLE AS m4 FROM embeddings")
def batch_predict(spark, sf):
    return X.batch_predict(long_predictions(spark, sf), "vec_id", MODELS)


MATCH_SQL = """WITH o AS (SELECT vec_id, j AS metric, embedding[j]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(1, 61)) AS j)),
pd AS (SELECT s AS source, vec_id, j AS metric, embedding[j + s]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(1, 61)) AS j), (SELECT unnest(range(1, 5)) AS s)),
q AS (SELECT metric, quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM pd GROUP BY 1),
ob AS (SELECT vec_id, metric, len(list_filter(q, lambda x: x < value)) AS b FROM o JOIN q USING (metric)),
pb AS (SELECT source, vec_id, metric, len(list_filter(q, lambda x: x < value)) AS b FROM pd JOIN q USING (metric)),
sc AS (SELECT source, avg(dist) AS score FROM (SELECT source, vec_id, sqrt(sum((pb.b - ob.b) * (pb.b - ob.b))) AS dist FROM pb JOIN ob USING (vec_id, metric) GROUP BY ALL) GROUP BY 1)
"""


@query("match_workload", MATCH_SQL + "SELECT CAST(source AS INTEGER) AS source, round(score, 6) AS score, source = (SELECT min_by(source, score) FROM sc) AS matched FROM sc")
def match_workload(spark, sf):
    e = table(spark, sf, "embeddings")

    def metrics(shift, *extra):
        return e.select("vec_id", *extra, F.posexplode(F.transform(F.slice("embedding", 1 + shift, 60), lambda x: x.cast("double"))).alias("metric", "value"))
    pred = None
    for s in MODELS:
        one = metrics(s, F.lit(s).alias("source"))
        pred = one if pred is None else pred.unionByName(one)
    return X.match_workload(metrics(0), pred, "vec_id").withColumn("score", r("score"))


LOSS_SQL = f"""WITH {ORACLE_PART_TRIALS}, ls AS (SELECT task_id, avg(size) / 60 AS loss FROM part_trials GROUP BY 1),
sim AS (SELECT task_id, 1 - loss AS similarity, (1 - loss) / sum(1 - loss) OVER () AS weight FROM ls),
cand AS (SELECT * FROM sim WHERE similarity > (SELECT quantile_cont(similarity, 0.5) FROM sim))
"""


def _losses(spark, sf):
    return part_trials(spark, sf).groupBy("task_id").agg((F.avg("size") / 60).alias("loss"))


@query("similar_tasks", LOSS_SQL + "SELECT task_id, round(similarity, 6) AS similarity, round(weight, 6) AS weight FROM cand")
def similar_tasks(spark, sf):
    return X.similar_tasks(_losses(spark, sf)).withColumns({"similarity": r("similarity"), "weight": r("weight")})


@query("sample_tasks", LOSS_SQL + """, d AS (SELECT task_id, -ln((CAST('0x' || substr(md5(task_id || ':1'), 1, 12) AS BIGINT) + 1) / (281474976710657.0::DOUBLE)) / weight AS k FROM cand)
SELECT task_id FROM (SELECT task_id FROM d ORDER BY k, task_id LIMIT 6) UNION SELECT 'Brand#1'""")
def sample_tasks(spark, sf):
    return X.sample_tasks(X.similar_tasks(_losses(spark, sf)), "Brand#1", 25)


@query("task_thresholds", LOSS_SQL + """, g AS (SELECT p.task_id, any_value(similarity) AS s, list_sort(list(-f1)) AS v, count(*) AS n, avg(f1) AS dp FROM part_trials p JOIN sim USING (task_id) GROUP BY 1),
q AS (SELECT *, (1 - 1e-9) - (1 - 2 * greatest(s - 0.5, 0)) * ((1 - 1e-9) - 1e-9) AS q FROM g), h AS (SELECT *, (n - 1) * q AS pos FROM q),
t AS (SELECT *, v[floor(pos)::INT + 1] + (v[ceil(pos)::INT + 1] - v[floor(pos)::INT + 1]) * (pos - floor(pos)) AS th FROM h)
SELECT task_id, round(CASE WHEN th < -dp THEN 0 ELSE q END, 6) AS q, round(th, 4) AS threshold FROM t""")
def task_thresholds(spark, sf):
    p = part_trials(spark, sf)
    sim = _losses(spark, sf).select("task_id", (1 - F.col("loss")).alias("similarity"))
    out = X.task_thresholds(p, sim, p.groupBy("task_id").agg(F.avg("f1").alias("default_perf")), "f1")
    return out.select("task_id", r("q").alias("q"), r("threshold", 4).alias("threshold"))


REG_SQL = LOSS_SQL + """, av AS (SELECT task_id, avg(f1) AS m FROM part_trials GROUP BY 1),
good AS (SELECT p.* FROM part_trials p JOIN av USING (task_id) WHERE f1 <= m),
reg AS (SELECT task_id, similarity, 'size' AS knob, min(size) / 60.0::DOUBLE AS low, max(size) / 60.0::DOUBLE AS high, avg(size) / 100 AS gain FROM good JOIN sim USING (task_id) GROUP BY ALL
 UNION ALL SELECT task_id, similarity, 'price', min(f1) / 3000, max(f1) / 3000, avg(size) / 10000 FROM good JOIN sim USING (task_id) GROUP BY ALL),
vt AS (SELECT DISTINCT task_id, similarity, 'kind' AS knob, kind AS value FROM good JOIN sim USING (task_id)),
tot AS (SELECT sum(similarity) AS s FROM sim)
"""


def _regions(spark, sf):
    p = H.with_group_stats(part_trials(spark, sf), ["task_id"], m=F.avg("f1")).filter("f1 <= m")
    p = materialize(p.join(_losses(spark, sf).select("task_id", (1 - F.col("loss")).alias("similarity")), "task_id"))
    g = p.groupBy("task_id", "similarity")
    size = g.agg((F.min("size") / 60.0).alias("low"), (F.max("size") / 60.0).alias("high"), (F.avg("size") / 100).alias("gain")).withColumn("knob", F.lit("size"))
    price = g.agg((F.min("f1") / 3000).alias("low"), (F.max("f1") / 3000).alias("high"), (F.avg("size") / 10000).alias("gain")).withColumn("knob", F.lit("price"))
    votes = p.select("task_id", "similarity", F.lit("kind").alias("knob"), F.col("kind").alias("value")).distinct()
    return size.unionByName(price), votes


@query("important_knobs_vote", REG_SQL + """SELECT knob, round(sum(similarity / s), 6) AS weight FROM (SELECT *, sum(gain) OVER (PARTITION BY task_id) AS tg FROM reg), tot
WHERE low <> high AND (gain > 0.01 OR gain > 0.1 * tg) GROUP BY 1""")
def important_knobs_vote(spark, sf):
    return X.important_knobs_vote(_regions(spark, sf)[0]).withColumn("weight", r("weight"))


CAT_SQL = REG_SQL + """, cats AS (SELECT knob, list_sort(list(value)) AS c FROM (SELECT knob, value FROM vt, tot GROUP BY ALL HAVING sum(similarity / s) > 1/3) GROUP BY 1 HAVING count(*) > 1),
ends AS (SELECT knob, low AS x FROM reg WHERE low <> high UNION SELECT knob, high FROM reg WHERE low <> high),
iv AS (SELECT knob, x AS a, lead(x) OVER (PARTITION BY knob ORDER BY x) AS b FROM ends),
hull AS (SELECT knob, min(a) AS low, max(b) AS high FROM (SELECT iv.knob, a, b FROM iv JOIN reg ON reg.knob = iv.knob AND reg.low <= a AND reg.high >= b CROSS JOIN tot WHERE reg.low <> reg.high GROUP BY ALL HAVING sum(similarity / s) > 1/3 + 1e-12) GROUP BY 1)
"""


@query("vote_categories", CAT_SQL + """SELECT knob, array_to_string(c, ',') AS choices, CASE WHEN list_contains(c, 'PROMO') THEN 'PROMO' ELSE c[1] END AS "default" FROM cats""")
def vote_categories(spark, sf):
    reg, votes = _regions(spark, sf)
    return X.vote_categories(votes, {"kind": "PROMO"}, reg).withColumn("choices", F.array_join("choices", ","))


@query("vote_ranges", CAT_SQL + """SELECT knob, round(low, 6) AS low, round(high, 6) AS high, round(least(greatest(CASE knob WHEN 'size' THEN 0.1 ELSE 0.99 END, low), high), 6) AS "default" FROM hull""")
def vote_ranges(spark, sf):
    return X.vote_ranges(_regions(spark, sf)[0], {"size": 0.1, "price": 0.99}).withColumns({c: r(c) for c in ("low", "high", "default")})


@query("compact_space", CAT_SQL + """SELECT knob, round(low, 6) AS low, round(high, 6) AS high, NULL::VARCHAR AS choices FROM hull UNION ALL SELECT knob, NULL, NULL, array_to_string(c, ',') FROM cats""")
def compact_space(spark, sf):
    reg, votes = _regions(spark, sf)
    out = X.compact_space(reg, votes, {"size": 0.1, "price": 0.99, "kind": "PROMO"}, only_range=True)
    return out.select("knob", r("low").alias("low"), r("high").alias("high"), F.array_join("choices", ",").alias("choices"))


# Importance

BIN_SQL = f"""WITH {ORACLE_TRIALS}, b AS (SELECT CAST(least(floor((quantity - 1.0) / (50.0 - 1.0) * 10), 9)::BIGINT AS VARCHAR) AS quantity, CAST(least(floor((discount - 0.0) / (0.11 - 0.0) * 10), 9)::BIGINT AS VARCHAR) AS discount,
 CAST(least(floor((tax - 0.0) / (0.09 - 0.0) * 10), 9)::BIGINT AS VARCHAR) AS tax, status, f1 AS y FROM trials), tv AS (SELECT var_pop(y) AS v FROM b)"""
PARAMS = ["quantity", "discount", "tax", "status"]
RANGES = {"quantity": (1.0, 50.0), "discount": (0.0, 0.11), "tax": (0.0, 0.09)}


def _anova_sql(order):
    from itertools import combinations
    names = sorted(PARAMS)
    ctes, rows = [], []
    for k in range(1, order + 1):
        for s in combinations(names, k):
            n = "_".join(s)
            low = [f"(SELECT s FROM s_{'_'.join(x)})" for j in range(1, k) for x in combinations(s, j)]
            joint = f"(SELECT var_pop(m) FROM (SELECT avg(y) AS m FROM b GROUP BY {', '.join(s)})) / (SELECT v FROM tv)"
            body = f"greatest(0, {joint} - ({' + '.join(low)}))" if low else joint
            ctes.append(f"s_{n} AS MATERIALIZED (SELECT {body} AS s)")
            if k == order:
                rows.append(f"SELECT '{','.join(s)}' AS params, round(s, 6) AS share FROM s_{n}")
    return BIN_SQL + ", " + ", ".join(ctes) + " " + " UNION ALL ".join(rows)


def _plain_trials(spark, sf):
    """Knobs and objective of the trials; the iteration number is not needed."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
                     F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("y"))


def _binned(spark, sf):
    return I.bin_params(_plain_trials(spark, sf), RANGES)


@query("anova_main", _anova_sql(1))
def anova_main(spark, sf):
    return I.anova_main(_binned(spark, sf), PARAMS, "y").withColumn("share", r("share"))


@query("anova_pair", _anova_sql(2))
def anova_pair(spark, sf):
    return I.anova_pair(_binned(spark, sf), PARAMS, "y").withColumn("share", r("share"))


@query("anova_triple", _anova_sql(3))
def anova_triple(spark, sf):
    return I.anova_triple(_binned(spark, sf), PARAMS, "y").withColumn("share", r("share"))


@query("anova_cutoffs", f"WITH {ORACLE_TRIALS}, q AS (SELECT quantile_cont(f1, 0.1) AS lo, quantile_cont(f1, 0.9) AS hi FROM trials) SELECT task_id, iter, round(least(greatest(f1, lo), hi), 4) AS y FROM trials, q")
def anova_cutoffs(spark, sf):
    t = trials(spark, sf).select("task_id", "iter", F.col("f1").alias("y"))
    return I.anova_cutoffs(t, "y", percentiles=(0.1, 0.9)).withColumn("y", r("y", 4))


@query("marginal_curve", BIN_SQL + " SELECT quantity AS bin, round(avg(y), 4) AS mean, round(stddev_pop(y), 4) AS std, count(*) AS n FROM b GROUP BY 1")
def marginal_curve(spark, sf):
    return I.marginal_curve(_binned(spark, sf), "quantity", "y").withColumns({"mean": r("mean", 4), "std": r("std", 4)})


@query("marginal_surface", BIN_SQL + " SELECT quantity AS bin_a, status AS bin_b, round(avg(y), 4) AS mean, round(stddev_pop(y), 4) AS std FROM b GROUP BY ALL")
def marginal_surface(spark, sf):
    return I.marginal_surface(_binned(spark, sf), "quantity", "status", "y").withColumns({"mean": r("mean", 4), "std": r("std", 4)})


@query("input_checks", f"""WITH {ORACLE_TRIALS} SELECT 'quantity' AS param, count(*) FILTER (NOT quantity BETWEEN 5 AND 45) AS violations FROM trials UNION ALL SELECT 'tax', count(*) FILTER (NOT tax BETWEEN 0.01 AND 0.07) FROM trials
UNION ALL SELECT 'status', count(*) FILTER (status NOT IN ('O')) FROM trials""")
def input_checks(spark, sf):
    return I.input_checks(_plain_trials(spark, sf), {"quantity": (5.0, 45.0), "tax": (0.01, 0.07)}, {"status": ["O"]})


@query("positive_attribution")
def positive_attribution(spark, sf):
    return I.positive_attribution(_plain_trials(spark, sf), ["quantity", "discount", "tax"], "y")


def _importance(spark, sf):
    return I.forest_importance(_plain_trials(spark, sf).drop("status"), ["quantity", "discount", "tax"], "y")


@query("forest_importance")
def forest_importance(spark, sf):
    return _importance(spark, sf)


@query("top_knobs", _anova_sql(1).replace(" SELECT 'discount' AS params", " SELECT params AS param, share FROM (SELECT 'discount' AS params") + ") ORDER BY share DESC, params LIMIT 2")
def top_knobs(spark, sf):
    share = I.anova_main(_binned(spark, sf), PARAMS, "y").withColumnRenamed("params", "param").withColumn("share", r("share"))
    return I.top_knobs(share, 2, "share")


@query("knob_schedule", f"WITH {ORACLE_PART_TRIALS} SELECT task_id, iter, CAST(least(4 + greatest(iter - 10, 0) // 5 * 5, 29) AS BIGINT) AS up, CAST(greatest(trunc(29.0::DOUBLE * pow(0.6::DOUBLE, greatest(iter - 10, 0) // 5)), 5) AS BIGINT) AS down FROM part_trials")
def knob_schedule(spark, sf):
    p = part_trials(spark, sf)
    up = I.knob_schedule(p, "increase", 4, 5, 10, 29).withColumnRenamed("n_knobs", "up")
    return I.knob_schedule(up, "decrease", 29, 5, 10, 29).select("task_id", "iter", "up", F.col("n_knobs").alias("down"))
