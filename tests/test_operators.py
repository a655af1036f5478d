"""Histories, fronts, parsers, transforms and designs on small inputs."""

import json
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kelpgrid.operators import design as DS
from kelpgrid.operators import pareto as PF
from kelpgrid.operators import transfer as X
from kelpgrid.operators import transforms as TR
from kelpgrid.operators import trials as H
from kelpgrid.operators.nearest import nearest_k
from kelpgrid.sources import history as HS
from kelpgrid.sources import logs as L
from kelpgrid.sources import points as PT
from kelpgrid.streaming.metrics import stream_metric_series


def front_of(y):
    return {i for i, a in enumerate(y) if not any((b <= a).all() and (b < a).any() for b in y)}


@pytest.mark.parametrize("m", [1, 2, 3, 4])
def test_pareto_front(spark, m):
    y = np.random.default_rng(m).integers(0, 8, (120, m)).astype(float)
    df = spark.createDataFrame(pd.DataFrame(y, columns=[f"f{i}" for i in range(m)]).assign(iter=range(120), task_id="a"))
    objs = [f"f{i}" for i in range(m)]
    got = {r["iter"] for r in PF.pareto_front(df, ["task_id"], objs).collect()}
    assert got == front_of(y)
    once = PF.pareto_front_distinct(df, ["task_id"], objs)
    assert once.count() == len({tuple(y[i]) for i in got})


def test_pareto_history(spark):
    y = np.random.default_rng(9).integers(0, 30, (60, 2)).astype(float)
    df = spark.createDataFrame(pd.DataFrame(y, columns=["f1", "f2"]).assign(iter=range(60), task_id="a"))
    got = {r["entered"]: r["left"] for r in PF.pareto_history(df, ["task_id"], "f1", "f2").collect()}
    alive, want = {}, {}
    for i, p in enumerate(y):
        if any((y[j] <= p).all() for j in alive):
            continue
        for j in [j for j in alive if (p <= y[j]).all()]:
            want[j] = i
            del alive[j]
        alive[i] = want[i] = None
    assert got == want


def failed_rows():
    """Runs of tasks a and null, some without an objective."""
    rows = [("a", 1, None, 1.0), ("a", 2, 5.0, None), ("a", 3, 5.0, 4.0), ("a", 4, 6.0, 4.0), ("a", 5, 4.0, 9.0), ("a", 6, 5.0, 3.0)]
    return [*rows, *((None, i, x, y) for _, i, x, y in rows), ("b", 1, None, 2.0)]


FAILED = "task_id string, iter long, f1 double, f2 double"


def test_fronts_of_failed_runs_and_null_tasks(spark):
    df = spark.createDataFrame(failed_rows(), FAILED)
    key = ["task_id"]
    want = {(t, i) for t in ("a", None) for i in (5, 6)}
    for objs in (["f1", "f2"], ["f1", "f2", "f3"]):
        got = PF.pareto_front(df.withColumn("f3", F.lit(1.0)), key, objs).collect()
        assert {(r["task_id"], r["iter"]) for r in got} == want
        got = PF.pareto_front_distinct(df.withColumn("f3", F.lit(1.0)), key, objs).collect()
        assert {(r["task_id"], r["iter"]) for r in got} == want
    history = PF.pareto_history(df, key, "f1", "f2")
    assert {(r["task_id"], r["entered"], r["left"]) for r in history.collect()} == {(t, i, x) for t in ("a", None) for i, x in ((3, 6), (5, None), (6, None))}
    volume = {(r["task_id"], r["iter"]): r["hypervolume"] for r in PF.hypervolume_history(history, key, "f1", "f2", (7.0, 10.0)).collect()}
    assert volume == {(t, i): v for t in ("a", None) for i, v in ((3, 12.0), (5, 13.0), (6, 15.0))}
    best = PF.objective_incumbents(df, key, ["f1", "f2"]).collect()
    assert {(r["task_id"], r["objective"], r["iter"]) for r in best} == {(t, o, i) for t in ("a", None) for o, i in (("f1", 5), ("f2", 1))} | {("b", "f2", 1)}
    assert PF.pareto_front(df.limit(0), key, ["f1", "f2"]).count() == 0


def brute_volume(points, ref):
    """Volume of a union of boxes on the grid of all coordinates."""
    axes = [np.unique(np.append(points[:, i], r)) for i, r in enumerate(ref)]
    axes = [a[a <= r] for a, r in zip(axes, ref)]
    grid = np.stack(np.meshgrid(*[a[:-1] for a in axes], indexing="ij"), -1)
    size = np.prod(np.stack(np.meshgrid(*[np.diff(a) for a in axes], indexing="ij"), -1), -1)
    return float(size[(points <= grid[..., None, :]).all(-1).any(-1)].sum())


@pytest.mark.parametrize("m,n,cell", [(2, 40, 256), (3, 40, 256), (4, 40, 4)])
def test_hypervolume(spark, m, n, cell):
    rng = np.random.default_rng(m * n)
    rows, want, ref = [], {}, [9.0] * m
    for task in ("a", None):
        y = rng.integers(0, 11, (n, m)).astype(float)
        want[task] = brute_volume(y[(y < ref).all(1)], ref)
        rows += [(task, *map(float, p)) for p in y] + [(task, None, *[0.0] * (m - 1))]
    objs = [f"f{i}" for i in range(m)]
    df = spark.createDataFrame(rows, "task_id string, " + ", ".join(f"{o} double" for o in objs))
    front = PF.pareto_front(df, ["task_id"], objs)
    got = {r["task_id"]: r["hypervolume"] for r in PF.hypervolume(front, ["task_id"], objs, ref, cell).collect()}
    assert got == pytest.approx(want)


def test_failed_only_task_and_ties(spark):
    rows = [("a", 1, 5.0, 1), ("a", 2, 6.0, 1), ("b", 1, 3.0, 0), ("b", 2, 3.0, 0), ("b", 3, 9.0, 1)]
    df = spark.createDataFrame(rows, "task_id string, iter long, y double, state int").withColumn("cfg", F.col("iter"))
    status = H.trial_status("state", ["y"])
    got = {(r["task_id"], r["iter"]): r["z"] for r in H.impute_failed(df, "y", status, "z").collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("b", 1): 3.0, ("b", 2): 3.0, ("b", 3): 3.0}
    assert H.incumbents(df.filter("state = 0"), "y", ["cfg"]).count() == 2


def test_constraint_allow_list(spark):
    with pytest.raises(ValueError):
        H.constraint_values(["java_method('x')"], {"tax"})
    with pytest.raises(ValueError):
        H.constraint_values(["secret - 1"], {"tax"})
    df = spark.createDataFrame([(2.0,)], "tax double")
    assert df.select(H.constraint_values(["tax*2 - 1"], {"tax"})[0]).first()[0] == 3.0


def test_malformed_lines(spark):
    lines = ["1,v,2008-02-02 18:46:38,POINT (1.5 2.5)", "no date POINT (1 2)", "2008-02-02 18:44:58 no point",
             "2008-02-02 18:44:58 POINT (1 2) POINT (3 4)", "", "2008-99-02 18:44:58 POINT (1 2)"]
    df = PT.parse_wkt_line(spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string"))
    got = {r["i"]: (r["x"], r["y"], r["t"]) for r in df.collect()}
    assert got[0] == (1.5, 2.5, 1.0) and got[3] == (1.0, 2.0, 0.0)
    assert {r["i"] for r in PT.reject_rows(df).collect()} == {1, 2, 4, 5}


def test_trial_log_edge_lines(spark):
    lines = ["x {'a': '007', 'b': 'ON', 'c': 2.75}|tps_1.5|lat_2|[1, 2]|65d", "{'a': 1}|tps_1.5"]
    rows = L.parse_trial_log(spark.createDataFrame([(s,) for s in lines], "line string")).collect()
    assert rows[0]["knobs"] == {"a": "7", "b": "ON", "c": "2"} and rows[0]["internal"] == [1.0, 2.0]
    assert rows[0]["metrics"] == {"tps": 1.5, "lat": 2.0}
    assert rows[1]["metrics"] == {} and rows[1]["internal"] == [None] * 65
    assert L.parse_trial_log(spark.createDataFrame([(s,) for s in lines], "line string"), valid_only=True).count() == 1


def test_benchmark_files_without_a_result(spark):
    lines = spark.createDataFrame([("a", 0, "trx: 10, 95%: 1.5, 99%: 2.5, max_rt:"), ("b", 0, "warm up")], "file string, line_no long, line string")
    assert {tuple(x) for x in L.bench_tpcc(lines).collect()} == {("a", 10.0, 2.5), ("b", 0.0, 0.0)}
    jobs = spark.createDataFrame([("a", 0, "head"), ("a", 1, "q\t2000"), ("b", 0, "head")], "file string, line_no long, line string")
    got = {x["file"]: (x["tps"], x["p95"], x["latency_var"]) for x in L.bench_job(jobs, 2, 4.0).collect()}
    assert got["b"] == (30.0, 4.0, 0.0) and got["a"][0] == 30.0 and got["a"][2] == 2.0


def test_maxint_objective_is_a_failure(spark):
    rows = spark.createDataFrame([(0, 2.0 ** 31 - 1), (0, 5.0), (1, 5.0), (0, None)], "state int, y double")
    assert [x[0] for x in rows.select(H.trial_status("state", ["y"])).collect()] == ["failed", "success", "failed", "failed"]


def test_sysbench_accept_rule(spark):
    def file(name, n):
        return [(name, f"tps: {i}.0 qps: 1.0 (r/w/o: 1.0/1.0/1.0) lat (ms,95%): 1.0 err/s: 0.0 reconn/s: 0.0") for i in range(10, 10 + n)]
    df = spark.createDataFrame(file("a", 10) + file("b", 7) + file("c", 8), "file string, line string")
    got = {r["file"]: r["tps"] for r in L.bench_sysbench(df).collect()}
    assert got == {"a": 14.5, "b": -1.0, "c": 13.5}


def test_history_documents(spark, tmp_path):
    doc = {"info": {"objs": ["-p"], "constraints": []}, "data": [
        {"configuration": {"a": "1", "zz": "9"}, "external_metrics": {"p": 2.0}, "trial_state": 0, "elapsed_time": 4.0},
        {"configuration": {}, "external_metrics": {}, "trial_state": 1, "elapsed_time": 1.0, "iter_time": 3.0}]}
    (tmp_path / "h.json").write_text(json.dumps(doc, indent=1))
    runs = HS.parse_history(HS.read_history_files(spark, [str(tmp_path)]), {"a": "5"})
    got = [(r["pos"], r["configuration"], r["iter_time"]) for r in runs.orderBy("pos").collect()]
    assert got == [(0, {"a": "1"}, 4.0), (1, {"a": "5"}, 3.0)]
    assert HS.valid_histories(runs).count() == 0


def test_states_add_up(spark):
    """Appending batches in any order gives the summary of one pass; tasks without a name and runs without a value included."""
    rng = np.random.default_rng(4)
    rows = [(t, None if rng.random() < 0.1 else float(rng.integers(0, 12)), int(rng.random() < 0.2), float(rng.normal())) for t in ("a", None, "b") for _ in range(70)]
    rows += [("c", None, 1, 0.0), ("d", None, 0, -1.0)]
    df = spark.createDataFrame([(*r, i, f"i-{r[0]}") for i, r in enumerate(rows)], "task_id string, y double, state int, c double, iter long, info string")
    status = H.trial_status("state", ["y"], ["c"])
    parts = [H.history_state(df.filter(f"iter % 3 = {k}"), "y", status, "info") for k in range(3)]
    merged = [H.merge_states(H.merge_states(parts[a], parts[b]), parts[c]) for a, b, c in ((0, 1, 2), (2, 0, 1))]
    want = {tuple(r) for r in H.state_summary(H.history_state(df, "y", status, "info")).collect()}
    assert all({tuple(r) for r in H.state_summary(m).collect()} == want for m in merged)
    for task, info, n, ok, failed, broken, best, p5, low, high in want:
        runs = [r for r in rows if r[0] == task]
        done = [y for _, y, s, c in runs if s == 0 and y is not None]
        good = [y for _, y, s, c in runs if s == 0 and y is not None and c <= 0]
        assert (info, n, ok, failed, broken) == (None if task is None else f"i-{task}", len(runs), len(good), len(runs) - len(done), len(done) - len(good)) or task is None
        assert best == (min(good) if good else None) and (low, high) == ((min(done), max(done)) if done else (None, None))
        assert p5 == (pytest.approx(np.percentile(done, 5)) if done else None)
    assert H.state_summary(H.history_state(df.filter("false"), "y", status)).count() == 0


def test_one_info_per_task(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 1, "y")], "task_id string, iter int, info string")
    same = spark.createDataFrame([(None, 2, "y"), ("a", 2, "x"), ("new", 1, "z")], old.schema)
    assert H.append_observation(old, same, "info").count() == 5
    other = spark.createDataFrame([(None, 2, "x")], old.schema)
    with pytest.raises(Exception, match="runs disagree about info in task null"):
        H.append_observation(old, other, "info").collect()
    states = [H.history_state(d.withColumn("y", F.lit(1.0)), "y", F.lit("success"), "info") for d in (old, other)]
    with pytest.raises(Exception, match="runs disagree about info"):
        H.state_summary(H.merge_states(*states)).collect()


def test_normalized_importance(spark):
    region = spark.createDataFrame([("a", "k", 1.0, 2.0), ("a", "z", 1.0, 2.0), ("b", "k", 0.0, 1.0), (None, "k", 0.0, 1.0)], "task_id string, knob string, low double, high double")
    share = spark.createDataFrame([("k", 3.0)], "knob string, importance double")
    default = spark.createDataFrame([("a", -6.0), ("b", 0.0), (None, 2.0)], "task_id string, default_perf double")
    got = {(r["task_id"], r["knob"]): r["importance"] for r in H.normalized_importance(region, share, default).collect()}
    assert got == {("a", "k"): 0.5, ("a", "z"): None, ("b", "k"): None, (None, "k"): 1.5}


@pytest.mark.parametrize("indent", [None, 1, 2, 4])
def test_split_documents(spark, tmp_path, indent):
    """One document read by many tasks in any layout; the order of its runs is kept."""
    data = [{"configuration": {"a": str(i), "t": 'x\n    {\n"y'}, "external_metrics": {"p": 2147483647 if i % 7 == 0 else i / 4}, "internal_metrics": [i, 0.5],
             "resource": {"m": i}, "trial_state": int(i % 7 == 0), "elapsed_time": 1.0, "iter_time": 2.0} for i in range(300)]
    (tmp_path / "h.json").write_text(json.dumps({"info": {"objs": ["-p", "m"], "constraints": ["m"]}, "data": data}, indent=indent))
    (tmp_path / "none.json").write_text(json.dumps({"info": {"objs": ["-p"], "constraints": []}, "data": []}, indent=indent))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        runs = HS.history_objectives(HS.read_history_documents(spark, str(tmp_path), {"a": "5", "t": "d", "new": "n"})).orderBy("pos").collect()
        first = HS.read_history_documents(spark, [str(tmp_path / "h.json")], {"a": "5"}, first_n=4)
        assert first.select(F.max("pos")).first()[0] == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["pos"] for r in runs] == list(range(300))
    for i, r in enumerate(runs):
        p = None if i % 7 == 0 else i / 4
        assert r["configuration"] == {"a": str(i), "t": 'x\n    {\n"y', "new": "n"} and r["external_metrics"] == {"p": p}
        assert r["objs"] == [p, -float(i)] and r["constraint_values"] == [float(i)] and r["internal_metrics"] == [float(i), 0.5] and r["context"] is None


def test_documents_come_back(spark, tmp_path):
    schema = ("file string, info struct<objs:array<string>,constraints:array<string>>, pos long, configuration map<string,string>, external_metrics map<string,double>, "
              "internal_metrics array<double>, resource map<string,double>, context array<double>, trial_state int, elapsed_time double, iter_time double")
    info = (["-p"], [])
    rows = [(f, info, i, {"a": f"v{i}", "q": '"}{'}, {"p": i / 3}, None, {"m": None}, [1.0 / (i + 1)], i % 2, None, 1e-300) for f in ("x y/z", "007", None) for i in range(25)]
    HS.write_history_documents(spark.createDataFrame(rows, schema), str(tmp_path / "d"), runs_per_file=10)
    files = sorted((tmp_path / "d").rglob("part-*"))
    assert len(files) == 9 and all(json.loads(f.read_text())["info"] == {"objs": ["-p"], "constraints": []} for f in files)
    back = HS.read_history_documents(spark, str(tmp_path / "d"), {"a": "", "q": ""}, written=True)
    got = {(r["history"], r["pos"]): tuple(r)[1:] for r in back.collect()}
    assert got == {(f, i): (info, i, *rest) for f, _, i, *rest in rows}
    bad = spark.createDataFrame([*rows, ("007", (["q"], []), 25, {}, {}, None, None, None, 0, 1.0, 1.0)], schema)
    with pytest.raises(Exception, match="runs disagree about info"):
        HS.write_history_documents(bad, str(tmp_path / "e"))


def test_packed_documents_come_back(spark, tmp_path):
    """Many small histories take as many files as tasks write, not one for each document."""
    schema = ("file string, info struct<objs:array<string>,constraints:array<string>>, pos long, configuration map<string,string>, external_metrics map<string,double>, "
              "internal_metrics array<double>, resource map<string,double>, context array<double>, trial_state int, elapsed_time double, iter_time double")
    info = (["-p"], [])
    names = [*(f"h {k}/" for k in range(60)), 'a"\n}', None]
    rows = [(f, info, i, {"a": f"v{i}", "q": '"}{\n'}, {"p": i / 3}, None, {"m": None}, [1.0 / (i + 1)], i % 2, None, 1e-300) for f in names for i in range(7)]
    HS.write_history_documents(spark.createDataFrame(rows, schema), str(tmp_path / "d"), runs_per_file=3, packed=True)
    files = list((tmp_path / "d").rglob("part-*"))
    docs = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    assert len(files) <= 8 and len(docs) == 3 * len(names) and all(d["info"] == {"objs": ["-p"], "constraints": []} and len(d["data"]) <= 3 for d in docs)
    back = HS.read_history_documents(spark, str(tmp_path / "d"), {"a": "", "q": ""}, packed=True)
    got = {(r["history"], r["pos"]): tuple(r)[1:] for r in back.collect()}
    assert got == {(f, i): (info, i, *rest) for f, _, i, *rest in rows}
    bad = spark.createDataFrame([*rows, ("h 1/", (["q"], []), 7, {}, {}, None, None, None, 0, 1.0, 1.0)], schema)
    with pytest.raises(Exception, match="runs disagree about info"):
        HS.write_history_documents(bad, str(tmp_path / "e"), packed=True)


def test_catalog_oversize(spark):
    text = json.dumps({"big": {"type": "integer", "min": 1024, "max": 2 ** 64, "default": 4096}, "m": {"type": "enum", "enum_values": ["on", "off"], "default": "on"}})
    rows = HS.load_knob_catalog(spark.createDataFrame([(text,)], "text string")).collect()
    assert (rows[0]["min"], rows[0]["default"]) == (1.0, "4.0") and rows[1]["choices"] == ["on", "off"]


def test_gaussian_rank_and_scores(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 3, 9, 1, 7])], "k string, id long, v double")
    got = {r["id"]: (r["clipped"], r["g"]) for r in TR.gaussian_rank(df, "v", ["k"], "id").collect()}
    for c, g in got.values():
        assert abs(NormalDist().inv_cdf(c) - g) < 1e-12
    s = spark.createDataFrame([(1, 0.5, 0.2), (2, -0.1, 0.0)], "id int, mu double, sigma double")
    row = s.select(DS.score_ei("mu", "sigma", F.lit(0.3)).alias("ei"), DS.score_pi("mu", "sigma", F.lit(0.3)).alias("pi")).collect()
    z = (0.3 - 0.01 - 0.5) / 0.2
    assert abs(row[0]["pi"] + NormalDist().cdf(z)) < 1e-12
    assert abs(row[0]["ei"] + (0.29 - 0.5) * NormalDist().cdf(z) + 0.2 * NormalDist().pdf(z)) < 1e-12
    assert row[1]["ei"] == 0.0


def test_designs(spark):
    base = spark.range(64).withColumnRenamed("id", "row")
    lhs = DS.lhs_design(base, 3, seed=1, criterion="maximin", draws=2).toPandas()
    for c in ("u0", "u1", "u2"):
        assert sorted((lhs[c] * 64).astype(int)) == list(range(64))
    assert [len(DS.primitive_polynomials(n)) for n in range(1, 9)] == [1, 1, 2, 2, 6, 6, 18, 16]
    assert [(d, a) for d, a, _ in map(DS.sobol_polynomial, range(1, 8))] == [(n, a) for n in range(1, 6) for a in DS.primitive_polynomials(n)][:7]
    sobol = DS.sobol_design(base, 44, seed=None).toPandas()
    assert len({tuple(sobol[c]) for c in sobol.columns}) == 45
    for c in [f"u{i}" for i in range(44)]:
        assert sorted((sobol[c] * 64).round(9).astype(int)) == list(range(64))
    space = [{"name": "a", "type": "integer", "low": 1, "high": 3}, {"name": "m", "type": "enum", "choices": ["x", "y"]}]
    seen = spark.createDataFrame([(1, "x")], "a long, m string")
    got = DS.random_design_distinct(base, space, seen, 5, seed=2).collect()
    assert len({tuple(r) for r in got}) == 5 and (1, "x") not in {tuple(r) for r in got}


def test_nearest_k(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (40, 3)), np.vstack([rng.normal(0, 1, (60, 3)), np.repeat([[0.1, 0.1, 0.1]], 30, axis=0)])
    fa = spark.createDataFrame(pd.DataFrame(a, columns=list("xyz")).assign(id=range(40)))
    fb = spark.createDataFrame(pd.DataFrame(b, columns=list("xyz")).assign(other=range(90)))
    got = nearest_k(fa, fb, "id", ["x", "y", "z"], 4, payload=["other"], order="other").toPandas()
    d = np.sqrt(((a[:, None] - b) ** 2).sum(-1))
    for i in range(40):
        want = sorted(range(90), key=lambda j: (d[i, j], j))[:4]
        assert sorted(got[got.id == i].other) == sorted(want)


def test_ridge_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (80, 2))
    y = 3 * x[:, 0] - x[:, 1] + 5 + rng.normal(0, 0.01, 80)
    df = spark.createDataFrame(pd.DataFrame({"task_id": "t", "id": range(80), "a": x[:, 0], "b": x[:, 1], "y": y}))
    m = X.fit_per_task(df, ["a", "b"], "y").first()
    assert abs(m["coef"][1] * m["y_std"] - 3) < 0.05 and abs(m["coef"][2] * m["y_std"] + 1) < 0.05
    oof = X.oof_predictions(df, ["task_id"], ["id"], ["a", "b"], "y").toPandas()
    assert len(oof) == 80 and np.abs(oof.mu * oof.y_std + oof.y_mean - oof.y).max() < 0.2
    far = df.withColumns({"a": F.col("a") + 1e9, "y": F.col("y") + 1e9})
    g = X.fit_per_task(far, ["a", "b"], "y").first()
    assert abs(g["y_mean"] - 1e9 - m["y_mean"]) < 1e-3 and abs(g["var"] - m["var"]) < 1e-4
    assert np.allclose(g["coef"][1:], m["coef"][1:], rtol=1e-4)
    noise = df.withColumns({"m1": F.col("y") / 10, "m2": -F.col("y")})
    w = X.simplex_weights(noise, "id", "y", ["m1", "m2"])
    assert w["m1"] > 0.9 and abs(sum(w.values()) - 1) < 0.01


def test_running_sums_give_the_pair_loss(spark):
    """Ties in y, within and across blocks, rows without y; the same sums as pair by pair."""
    rng = np.random.default_rng(8)
    y = np.concatenate([rng.integers(0, 40, 300) / 4.0, np.full(100, 5.25)])
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "y": y, **{f"m{i}": rng.normal(0, 2, 400) for i in range(3)}}))
    names, w = ["m0", "m1", "m2"], [0.5, 0.3, 0.2]
    low, high = (df.select(F.least(*[F.min(m) for m in names]), F.greatest(*[F.max(m) for m in names])).first())
    want = X.pair_loss_sums(X.pair_blocks(df, [], "id", "y", names, 64), [], w, "log").first()
    odd = df.unionByName(df.limit(3).withColumn("y", F.lit(None).cast("double"))).unionByName(df.limit(2).withColumn("y", F.lit(float("nan"))))
    blocks = X.ordered_blocks(odd, "id", "y", names, 16)
    assert blocks.agg(F.max(F.size("y"))).first()[0] == 16
    got = X.ordered_loss_sums(blocks, w, low, high, X._loss_terms(high - low)).first()
    assert got["pairs"] == want["pairs"] and np.allclose(list(got)[1:], list(want)[1:], rtol=1e-11)
    assert X._loss_terms(1e4) is None


def test_models_of_first_runs(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"task_id": ["a"] * 30 + ["b"] * 8, "iter": [*range(0, 60, 2), *range(8)], "x": rng.normal(size=38), "y": rng.normal(size=38)}))
    got = {m["task_id"]: m for m in X.fit_per_task(df, ["x"], "y", first_n=10).collect()}
    want = {m["task_id"]: m for m in X.fit_per_task(df.filter("iter < 20"), ["x"], "y").collect()}
    assert set(got) == {"a", "b"} and all(np.allclose(got[t]["coef"], want[t]["coef"]) for t in got)


def test_cloud_log_without_a_rate(spark):
    lines = spark.createDataFrame([("a", "t 0 ok a b c Request/s:4 end"), ("a", "warm up"), ("a", "t 0 ok a b c Request/s:6 end"), ("b", "warm up"), ("c", "Request/s")], "file string, line string")
    assert {r["file"]: r["qps"] for r in L.bench_cloud(lines).collect()} == {"a": 5.0, "b": None, "c": None}


def test_list_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("a.csv", "12345"), ("d/b.csv", "1"), ("d/c.txt", "x"), ("none.csv", "")):
        (tmp_path / name).write_text(text)
    got = {r["file"].rsplit("/", 1)[1]: r["bytes"] for r in PT.list_files(spark, [str(tmp_path)], "*.csv").collect()}
    assert got == {"a.csv": 5, "b.csv": 1}


def test_pair_blocks_split_a_task(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"task": 1, "id": range(50), "y": rng.integers(0, 9, 50).astype(float), "a": rng.normal(0, 1, 50)})
    df = spark.createDataFrame(pdf)
    one = X.pair_loss(X.pair_blocks(df, ["task"], "id", "y", ["a"], size=100), ["task"], [1.0], "log").first()["value"]
    many = X.pair_loss(X.pair_blocks(df, ["task"], "id", "y", ["a"], size=7), ["task"], [1.0], "log").first()["value"]
    d = [np.log1p(np.exp(q.a - p.a)) for p in pdf.itertuples() for q in pdf.itertuples() if p.y > q.y]
    assert abs(one - np.mean(d)) < 1e-9 and abs(many - np.mean(d)) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    rows = [("cpu", f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(0, 50, 5)]
    df = spark.createDataFrame(rows, "metric string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    out = stream_metric_series(spark, str(tmp_path / "in"), df.schema, "10 minutes", "1 minute")
    q = out.writeStream.outputMode("complete").format("memory").queryName("series").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("series").orderBy("start").select("mean").toPandas()["mean"].tolist()
    assert got == [2.5, 12.5, 22.5, 32.5, 42.5]


def test_normal_functions_and_draws(spark):
    from kelpgrid.functions.expressions import hash_unit, normal_cdf, normal_quantile
    zs = [-40.0, -8.0, -3.3, -1.0, 0.0, 0.2, 2.5, 7.5, None, float("nan")]
    got = [x[0] for x in spark.createDataFrame([(z,) for z in zs], "z double").select(normal_cdf(F.col("z"))).collect()]
    for z, v in zip(zs, got):
        assert v is None if z is None or z != z else abs(v - NormalDist().cdf(z)) < 1e-12
    ps = [1e-300, 1e-12, 0.01, 0.2, 0.5, 0.8, 0.9999, 0.0, 1.0, None]
    got = [x[0] for x in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    for p, v in zip(ps, got):
        assert v is None if not p or p == 1 else abs(v - NormalDist().inv_cdf(p)) < 1e-9
    ids = spark.range(2000).select(F.col("id"), hash_unit(F.col("id"), "1").alias("u"))
    one, two = {x.id: x.u for x in ids.collect()}, {x.id: x.u for x in ids.repartition(7).collect()}
    assert one == two and 0 <= min(one.values()) and max(one.values()) < 1 and abs(np.mean(list(one.values())) - 0.5) < 0.03


def test_target_loss_and_fold_predictions(spark):
    rng = np.random.default_rng(5)
    rows = [(t, i, *map(float, rng.integers(0, 6, 3))) for t in ("a", None) for i in range(23)]
    df = spark.createDataFrame(rows, "task_id string, i long, x double, z double, y double")
    every = X.fold_predictions(df, ["task_id"], ["i"], ["x", "z"], "y")
    got = every.toPandas()
    assert len(got) == 23 * 5 * 2 and set(got["left_out"]) == set(range(5))
    own = {(r["task_id"], r["i"]): r["mu"] for r in X.oof_predictions(df, ["task_id"], ["i"], ["x", "z"], "y").collect()}
    same = every.filter("fold = left_out").collect()
    assert {(r["task_id"], r["i"]): r["mu"] for r in same} == pytest.approx(own)
    loss = {r["task_id"]: r["misranked"] for r in X.ranking_loss_target(every, ["task_id"], "i", "y", "mu").collect()}
    for t in ("a", None):
        part = got[got["task_id"].isna()] if t is None else got[got["task_id"] == t]
        want = 0
        for f, g in part.groupby("left_out"):
            ys, ps, own_fold = g["y"].to_numpy(), g["mu"].to_numpy(), (g["fold"] == f).to_numpy()
            want += int((((ys[:, None] < ys) != (ps[:, None] < ps))[own_fold]).sum())
        assert loss[t] == want


def test_transfer_joins_keep_tasks_without_a_name(spark):
    rows = [(t, i, float(i), float(i % 3)) for t in ("a", None) for i in range(6)]
    df = spark.createDataFrame(rows, "task_id string, i long, y double, p double").withColumn("model", F.lit(1))
    assert {r["task_id"] for r in X.ranking_loss(df, ["task_id"], "i", "y", "p").collect()} == {"a", None}
    assert {r["task_id"] for r in X.fit_fidelity_weights(df, ["task_id"], "i", "y", "p").collect()} == {"a", None}
    tasks = df.select("task_id").distinct()
    got = X.task_thresholds(df, tasks.withColumn("similarity", F.lit(0.8)), tasks.withColumn("default_perf", F.lit(3.0)), "y")
    assert {r["task_id"] for r in got.collect()} == {"a", None}
