"""Joins of tables that are as long as the data must not send one of them through the driver."""

from pyspark.sql import functions as F

from kelpgrid.functions.dominance import dominated, lowest_below
from kelpgrid.functions.ordering import with_group_stats, with_previous, with_running
from kelpgrid.operators import components, density, grid, nearest, trials
from kelpgrid.session import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def recorded(monkeypatch, module):
    """The plans that ``module`` writes."""
    plans = []
    monkeypatch.setattr(module, "materialize", lambda df: plans.append(plan(df)) or materialize(df))
    return plans


def test_scans_do_not_broadcast_exploded_rows(spark):
    t = materialize(spark.range(300).select("id", (F.col("id") % 7).alias("g"), (F.col("id") * 37 % 101).alias("v")))
    lv = t.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(9))))
    for out in (with_running(lv, ["g", "l"], ["id"], {"s": ("sum", "v")}), with_previous(lv, ["g", "l"], ["id"], {"p": "v"}),
                dominated(t, ["g"], ["v", "id"], ["id"], "id", {"n": ("count", "id")}),
                lowest_below(t, ["g"], [["v", "id"], ["id", "v"]], "id", "v", "low")):
        assert "BroadcastHashJoin" not in plan(out)
        assert out.count() in (300, 3000)


def test_neighbour_probes_are_not_broadcast(spark, monkeypatch):
    plans = recorded(monkeypatch, density)
    pts = materialize(spark.range(200).select("id", (F.col("id") * 7 % 23).cast("double").alias("x"), (F.col("id") * 5 % 19).cast("double").alias("y"),
                                              (F.col("id") * 3.0).alias("t")))
    got = {r["id"]: r["n"] for r in density.neighbor_counts(pts, 3.0, 60.0).collect()}
    rows = pts.collect()
    for a in rows:
        assert got[a["id"]] == sum((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 <= 9 and abs(a["t"] - b["t"]) <= 60 for b in rows)
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


def test_ring_search_does_not_broadcast_probes(spark, monkeypatch):
    plans = recorded(monkeypatch, nearest)
    t = materialize(spark.range(60).select("id", *[(F.col("id") * k % 31).cast("double").alias(c) for k, c in ((7, "a"), (11, "b"), (13, "c"), (17, "d"))]))
    near = nearest.nearest_k(t, t.withColumnRenamed("id", "other"), "id", ["a", "b", "c", "d"], 2, payload=["other"], order="other")
    assert near.count() == 120
    probes = [p for p in plans if "k_a#" in p]
    assert probes and not [p for p in probes if "BroadcastHashJoin" in p]


def test_few_groups_do_not_deal_the_rows_by_group(spark):
    """Statistics of three groups go to the rows; sorted by group a third of the rows would be in one task."""
    t = spark.range(5_000_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("task_id"), (F.col("id") % 1000).alias("y"))
    out = with_group_stats(t, ["task_id"], top=F.max("y"))
    good = trials.promising_categories(t, "y", t.groupBy("task_id").agg(F.avg("y").alias("threshold")), ["y"])
    assert "SortMergeJoin" not in plan(out) and "SortMergeJoin" not in plan(good)
    assert out.filter("top = 999").count() == 5_000_000


def test_components_do_not_broadcast_edges(spark, monkeypatch):
    plans = recorded(monkeypatch, components)
    edges = materialize(spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    comp = components.connected_components(edges, local_edges=10)
    assert comp.filter("root = 0").count() == 401
    hist = materialize(spark.range(300).select((F.col("id") + 1).alias("cell_id"), (F.col("id") % 20).alias("cx"), F.floor(F.col("id") / 20).alias("cy"), F.lit(0).cast("long").alias("ct"), F.lit(2).alias("n")))
    assert not [p for p in [*plans, plan(grid.cell_adjacency(hist))] if "BroadcastHashJoin" in p]
