"""Attribution under boosted trees: rows in the same bins as one weighted row, against the trees over all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from kelpgrid.operators import importance as I


def over_all_rows(df, features, y):
    data = I.materialize(df.select(*features, (-F.col(y)).alias("__y")))
    of = lambda d: VectorAssembler(inputCols=features, outputCol="features").transform(d)
    model = GBTRegressor(labelCol="__y", maxIter=20, maxDepth=4, seed=1, predictionCol="__full").fit(of(data))
    base = model.transform(of(data)).drop("features").toPandas()
    out = {}
    for c in features:
        changed = df.sparkSession.createDataFrame(base.assign(**{c: base[c].mean()}))
        alt = model.setPredictionCol("__alt").transform(of(changed)).toPandas()
        out[c] = float(np.maximum(0.0, alt["__full"] - alt["__alt"]).mean())
    return out


def test_positive_attribution_trains_on_bins(spark, monkeypatch):
    """Over continuous features too the trees get at most as many rows as there are combinations of bins."""
    rng = np.random.default_rng(4)
    n = 3000
    a, b = rng.normal(0, 1, n), rng.choice([0.0, 1.0, 1.5, 4.0], n, p=[0.6, 0.2, 0.1, 0.1])
    pdf = pd.DataFrame({"a": a, "b": b, "c": 7.0, "y": 3 * a + b * b + rng.normal(0, 0.1, n)})
    df = spark.createDataFrame(pd.concat([pdf, pdf[:500]]))
    want = over_all_rows(df, ["a", "b", "c"], "y")
    trained, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, d, *x: trained.append(d.count()) or fit(self, d, *x))
    got = {r["param"]: r["attribution"] for r in I.positive_attribution(df, ["a", "b", "c"], "y").collect()}
    assert got == pytest.approx(want, rel=1e-6) and got["c"] == 0.0
    assert trained and max(trained) <= 32 * 4


def test_positive_attribution_of_many_rows_takes_the_split_points_of_the_trees(spark):
    """Over 10,000 rows Spark's trees take split points from the rows they draw: the same ones."""
    rng = np.random.default_rng(5)
    n = 25_000
    a, b = rng.exponential(1.0, n).round(2), rng.integers(0, 90, n) / 10
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": 3 * a + b * b + rng.normal(0, 1, n)})).repartition(3)
    want = over_all_rows(df, ["a", "b"], "y")
    assert {r["param"]: r["attribution"] for r in I.positive_attribution(df, ["a", "b"], "y").collect()} == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("row", [(None, 1.0), (float("nan"), 1.0), (1.0, None), (1.0, float("nan")), (1.0, float("inf"))])
def test_positive_attribution_of_missing_values_fails(spark, row):
    df = spark.createDataFrame([(float(i % 5), float(i)) for i in range(40)] + [row], "a double, y double")
    with pytest.raises(Exception):
        I.positive_attribution(df, ["a"], "y").collect()
