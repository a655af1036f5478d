"""Pairwise comparison and ranking of runs.

The full pair table has n(n-1)/2 rows, so nothing here builds it: totals over
all pairs come from dominance counts, wins of a tournament from ranks, and
models learn from disjoint pairs, which are linear in the runs.
"""

from __future__ import annotations

from pyspark.ml import classification as C
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions.dominance import dominated
from kelpgrid.functions.ordering import with_group_stats, with_row_number
from kelpgrid.operators.nearest import nearest_k
from kelpgrid.session import materialize

SEED = 42


def all_pairs(df: DataFrame, key: str, y: str) -> DataFrame:
    """Summary of all pairs (i, j), i < j by key, per first row i.

    ``pairs`` partners, ``greater`` partners with a smaller result (label 1) and
    ``greater_sum``, the sum of those results; exact, without listing pairs.
    """
    t = df.select(key, y).withColumns({"__k": -F.col(key), "__one": F.lit(1)})
    # Later keys come first in the order; of equal results the later key counts as larger.
    out = dominated(t, [], ["__k"], [y, key], key, {"greater": ("count", "__one"), "greater_sum": ("sum", y)})
    later = with_row_number(out, [], ["__k"], "__rn")
    return later.select(key, (F.col("__rn") - 1).alias("pairs"), "greater", F.coalesce("greater_sum", F.lit(0.0)).alias("greater_sum"))


def hash_order(key: str, seed: int) -> Column:
    """48 bits of an md5 as a number: a fixed pseudo-random order."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("long")


def disjoint_pairs(df: DataFrame, key: str, features: list[str], y: str, seed: int = SEED) -> DataFrame:
    """Random permutation, neighbours paired: both feature rows, label 1 if the first is smaller."""
    t = df.select(key, *features, y).withColumn("__h", hash_order(key, seed))
    t = with_row_number(t, [], ["__h", key], "__rn").withColumn("pair", F.floor((F.col("__rn") - 1) / 2))
    side = F.struct(key, *features, y)
    odd = F.col("__rn") % 2 == 1
    g = t.groupBy("pair").agg(F.max(F.when(odd, side)).alias("a"), F.max(F.when(~odd, side)).alias("b")).filter("b is not null")
    return g.select("pair", *[F.col(f"{s}.{c}").alias(f"{c}_{i}") for i, s in ((1, "a"), (2, "b")) for c in (key, *features)],
                    F.when(F.col(f"a.{y}") < F.col(f"b.{y}"), 1).otherwise(0).alias("label"))


def train_test(df: DataFrame, key: str, share: float = 0.8, seed: int = SEED) -> DataFrame:
    """``is_train`` by hash: the same rows for any partitioning."""
    return df.withColumn("is_train", hash_order(key, seed) < F.lit(int(share * 2 ** 48)))


CLASSIFIERS = {
    "lr": lambda: C.LogisticRegression(maxIter=100),
    "svm": lambda: C.LinearSVC(maxIter=50),
    "dt": lambda: C.DecisionTreeClassifier(maxDepth=8, seed=SEED),
    "rf": lambda: C.RandomForestClassifier(numTrees=50, maxDepth=8, seed=SEED),
    "nb": lambda: C.NaiveBayes(modelType="gaussian"),
    "gbt": lambda: C.GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.1, seed=SEED),
}


def _vector(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="raw").transform(df)


def fit_pair_classifier(pairs: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """Fit on the training pairs, predict the test pairs: ``(pair, label, prediction)``."""
    data = materialize(train_test(pairs, "pair"))
    train, test = _vector(data.filter("is_train"), cols), _vector(data.filter("not is_train"), cols)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    train, test = scaler.transform(train), scaler.transform(test)
    if kind == "nn":
        model = C.MultilayerPerceptronClassifier(layers=[len(cols), 16, 2], maxIter=100, seed=SEED)
    else:
        model = CLASSIFIERS[kind]()
    return model.fit(train).transform(test).select("pair", "label", F.col("prediction").cast("int").alias("prediction"))


def fit_pair_knn(pairs: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """Majority of the k nearest training pairs (exact ring search, ties by pair number)."""
    data = materialize(train_test(pairs, "pair"))
    near = nearest_k(data.filter("not is_train"), data.filter("is_train").withColumnRenamed("pair", "other"), "pair", cols, k,
                     payload=["label"], order="other")
    vote = near.groupBy("pair").agg((F.avg("label") > 0.5).cast("int").alias("prediction"))
    return data.filter("not is_train").select("pair", "label").join(vote, "pair")


def _differences(pairs: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    cols = {f"d_{f}": (F.col(f"{f}_1") - F.col(f"{f}_2")).cast("double") for f in features}
    return pairs.withColumns(cols), list(cols)


def fit_rank(pairs: DataFrame, df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Pairwise ranker: logistic regression without intercept on differences; returns a score per run."""
    d, cols = _differences(pairs, features)
    model = C.LogisticRegression(fitIntercept=False, maxIter=100, featuresCol="raw").fit(_vector(d, cols))
    score = F.lit(0.0)
    for c, w in zip(features, model.coefficients):
        score = score + F.col(c) * F.lit(float(w))
    return df.select(key, score.alias("score"))


def fit_siamese(pairs: DataFrame, features: list[str]) -> DataFrame:
    """Small network on signed differences (an absolute difference cannot tell the order)."""
    d, cols = _differences(pairs, features)
    return fit_pair_classifier(d.select("pair", "label", *cols), cols, "nn")


def pair_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", keys: list[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    t = df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.select(*keys, ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
                    ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def ndcg(df: DataFrame, keys: list[str], key: str, y: str, score: str) -> DataFrame:
    """Discounted gain of the predicted order over that of the ideal one; tied scores share their discounts."""
    t = df.withColumns({"__s": -F.col(score), "__y": -F.col(y)})
    t = with_row_number(t, keys, ["__s", key], "__r")
    t = with_row_number(t, keys, ["__y", key], "__i")
    disc = {c: 1.0 / (F.log2(F.col(c) + 1)) for c in ("__r", "__i")}
    ties = t.groupBy(*keys, "__s").agg((F.avg(y) * F.sum(disc["__r"])).alias("dcg"), F.sum(F.col(y) * disc["__i"]).alias("ideal"))
    return ties.groupBy(*keys).agg(F.try_divide(F.sum("dcg"), F.sum("ideal")).alias("ndcg"))


def tournament_wins(pairs: DataFrame) -> DataFrame:
    """Wins per row of predicted pairs ``(first, second, prediction)``; 0 means the first wins."""
    winner = F.when(F.col("prediction") == 0, F.col("first")).otherwise(F.col("second"))
    return pairs.groupBy(winner.alias("id")).agg(F.count(F.lit(1)).alias("wins"))


def tournament_best(df: DataFrame, key: str, score: str) -> DataFrame:
    """Wins of every row against all others when the smaller score wins and the earlier row wins ties.

    That is n minus the rank, so no pair is compared; ``best`` marks the winner.
    """
    t = with_row_number(df.select(key, score), [], [score, key], "__rn")
    t = with_group_stats(t, [], __n=F.count(F.lit(1)))
    return t.select(key, (F.col("__n") - F.col("__rn")).alias("wins"), (F.col("__rn") == 1).alias("best"))
