"""Ordered helpers against pandas, with a hot key and heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kelpgrid.functions.dominance import dominated, rising_pairs
from kelpgrid.functions.ordering import quantiles, with_previous, with_row_number, with_running
from kelpgrid.operators import transfer as X


def frame(n=600, seed=0):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n))
    v = np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 20, n).astype(float))
    return pd.DataFrame({"k": key, "id": np.arange(n), "v": v, "w": rng.random(n).round(2)})


def test_row_number_and_running(spark):
    pdf = frame()
    got = with_running(spark.createDataFrame(pdf), ["k"], ["v", "id"], {
        "s": ("sum", "w"), "m": ("min", "w"), "n": ("count", F.lit(1))}).toPandas().sort_values(["k", "v", "id"])
    want = pdf.sort_values(["k", "v", "id"])
    g = want.groupby("k")["w"]
    assert (got["id"].to_numpy() == want["id"].to_numpy()).all()
    np.testing.assert_allclose(got["s"], g.cumsum())
    np.testing.assert_allclose(got["m"], g.cummin())
    assert (got["n"].to_numpy() == want.groupby("k").cumcount().to_numpy() + 1).all()


def test_global_row_number_and_empty(spark):
    pdf = frame(200)
    got = with_row_number(spark.createDataFrame(pdf), [], ["v", "id"]).toPandas().sort_values("rn")
    assert list(got["rn"]) == list(range(1, 201))
    assert list(got["id"]) == list(pdf.sort_values(["v", "id"])["id"])
    empty = spark.createDataFrame([], "k string, v double, id long")
    assert with_row_number(empty, ["k"], ["v", "id"]).count() == 0


def test_previous(spark):
    pdf = frame()
    got = with_previous(spark.createDataFrame(pdf), ["k"], ["v", "id"], {"p": "id"}).toPandas().sort_values(["k", "v", "id"])
    want = pdf.sort_values(["k", "v", "id"]).groupby("k")["id"].shift(1)
    assert got["p"].fillna(-1).astype(int).tolist() == want.fillna(-1).astype(int).tolist()


def test_quantiles(spark):
    pdf = frame()
    got = quantiles(spark.createDataFrame(pdf), ["k"], "v", {"a": 0.05, "b": 0.5, "c": 1.0}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, ["a", "b", "c"]].astype(float), np.quantile(g["v"], [0.05, 0.5, 1.0]))


def test_dominated(spark):
    pdf = frame(150, seed=3)
    got = dominated(spark.createDataFrame(pdf), ["k"], ["v", "id"], ["w", "id"], "id", {"n": ("count", F.lit(1)), "s": ("sum", "v"), "m": ("min", "v")})
    got = got.toPandas().set_index("id")
    for _, g in pdf.groupby("k"):
        for r in g.itertuples():
            s = g[((g.v < r.v) | ((g.v == r.v) & (g.id < r.id))) & ((g.w < r.w) | ((g.w == r.w) & (g.id < r.id)))]
            assert got.loc[r.id, "n"] == len(s)
            assert abs(got.loc[r.id, "s"] - s.v.sum()) < 1e-9
            assert (np.isnan(got.loc[r.id, "m"]) and not len(s)) or got.loc[r.id, "m"] == s.v.min()


def test_ranking_loss_with_ties(spark):
    pdf = frame(80, seed=5)
    got = X.ranking_loss(spark.createDataFrame(pdf), ["k"], "id", "v", "w").toPandas().set_index("k")
    share = X.order_preserving(spark.createDataFrame(pdf), ["k"], "id", "v", "w").toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        v, w = g.v.to_numpy(), g.w.to_numpy()
        assert got.loc[k, "misranked"] == sum((a < b) != (c < d) for a, c in zip(v, w) for b, d in zip(v, w))
        pairs = [(i, j) for i in range(len(g)) for j in range(i + 1, len(g))]
        assert abs(share.loc[k, "share"] - np.mean([(v[i] > v[j]) == (w[i] > w[j]) for i, j in pairs])) < 1e-12


def test_null_keys_and_order_values_survive(spark):
    from kelpgrid.functions.ordering import quantiles, with_group_stats, with_previous, with_row_number, with_running

    rows = [("a", 1.0, 1), ("a", None, 2), ("a", None, 3), (None, 2.0, 4), (None, None, 5), ("a", 5.0, 6)]
    df = spark.createDataFrame(rows, "k string, v double, id long")
    got = {r["id"]: r["rn"] for r in with_row_number(df, ["k"], ["v", "id"]).collect()}
    assert got == {2: 1, 3: 2, 1: 3, 6: 4, 5: 1, 4: 2}
    assert sorted(r["rn"] for r in with_row_number(df, [], ["v", "id"]).collect()) == [1, 2, 3, 4, 5, 6]
    run = {r["id"]: r["s"] for r in with_running(df, ["k"], ["v", "id"], {"s": ("sum", "id")}).collect()}
    assert run == {2: 2, 3: 5, 1: 6, 6: 12, 5: 5, 4: 9}
    prev = {r["id"]: r["p"] for r in with_previous(df, ["k"], ["v", "id"], {"p": "id"}).collect()}
    assert prev == {2: None, 3: 2, 1: 3, 6: 1, 5: None, 4: 5}
    assert {r["k"]: r["m"] for r in quantiles(df, ["k"], "v", {"m": 0.5}).collect()} == {"a": 3.0, None: 2.0}
    assert {r["id"]: r["n"] for r in with_group_stats(df, ["k"], n=F.count("id")).collect()} == {1: 4, 2: 4, 3: 4, 4: 2, 5: 2, 6: 4}


def test_trial_log_with_python_literals_and_repeated_names(spark):
    from kelpgrid.sources.logs import parse_trial_log

    line = "{'a': True, 'b': 3, 'c': None}|tps_1.5|tps_2.5|lat_x|[]|"
    r = parse_trial_log(spark.createDataFrame([(line,)], "line string")).first()
    assert r["knobs"] == {"a": "true", "b": "3", "c": None} and r["metrics"] == {"tps": 2.5, "lat": None}


@pytest.mark.parametrize("size", [7, 40, 10_000])
def test_rising_pairs(spark, size):
    """Ties, nulls, NaN, heavy values and null keys; groups cut into many ranges or none."""
    rng = np.random.default_rng(size)
    rows = []
    for g, n in (("a", 150), ("b", 30), (None, 60), ("c", 1), ("d", 80)):
        for _ in range(n):
            y = None if rng.random() < 0.05 else float(rng.integers(0, 12)) if g != "d" else 3.0
            p = None if rng.random() < 0.05 else float("nan") if rng.random() < 0.05 else float(rng.integers(-4, 5)) if rng.random() < 0.5 else float(rng.normal())
            rows.append((g, y, p))

    def rank(v):
        return (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    want = {g: sum(rank(i[1]) < rank(j[1]) and rank(i[2]) < rank(j[2]) for i in rows for j in rows if i[0] == j[0] == g) for g, _, _ in rows}
    got = rising_pairs(spark.createDataFrame(rows, "g string, y double, p double"), ["g"], "y", "p", "n", size)
    assert {r["g"]: r["n"] for r in got.collect()} == want
