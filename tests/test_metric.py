"""Nearest rows over vectors against brute force."""

import numpy as np
import pytest

from kelpgrid.operators import metric as M

SCHEMA = "id long, v array<double>"


def brute(cand, rows, k, skip):
    ok = [(i, np.array(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for key, v in cand:
        if v is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        best = sorted((float(np.sqrt(((w - np.array(v)) ** 2).sum())), i) for i, w in ok if not (skip and i == key))[:k]
        for rank, (d, i) in enumerate(best, 1):
            out[key, rank] = (i, pytest.approx(d, abs=1e-12))
    return out


@pytest.mark.parametrize("k,skip,shell", [(1, False, 16), (3, True, 16), (5, False, 4096), (40, True, 16)])
def test_nearest_vectors(spark, monkeypatch, k, skip, shell):
    monkeypatch.setattr(M, "SHELL", shell)
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 10)) * 4
    rows = [(i, (centres[i % 6] + rng.integers(-2, 3, 10) * 0.25).tolist()) for i in range(200)]
    rows += [(200 + i, centres[0].tolist()) for i in range(60)]  # one point many times
    rows += [(300, None), (301, [None] * 10), (302, [float("nan")] * 10), (303, [float("inf")] * 10)]
    cand = rows[::3] + [(300, None), (999, [50.0] * 10)]
    df, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(cand, SCHEMA)
    got = {(r["id"], r["rank"]): (r["other"], r["distance"]) for r in M.nearest_vectors(asked.toDF("id", "v"), df, "id", "v", k, skip_same=skip, pivots=7).toDF(
        "id", "rank", "other", "distance").collect()}
    assert got == brute(cand, rows, k, skip)


def test_few_or_no_rows(spark):
    two, none = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], SCHEMA), spark.createDataFrame([], SCHEMA)
    got = M.nearest_vectors(two.withColumnRenamed("id", "key"), two, "key", "v", 5, other_key="id")
    assert {(r["key"], r["rank"]): r["distance"] for r in got.collect()} == {(1, 1): 0.0, (1, 2): 5.0, (2, 1): 0.0, (2, 2): 5.0}
    assert M.nearest_vectors(none, two, "id", "v").count() == 0 and M.nearest_vectors(two, none, "id", "v").count() == 0
    assert M.nearest_vectors(two.filter("id = 1"), two.filter("id = 1"), "id", "v", 2, skip_same=True).count() == 0
