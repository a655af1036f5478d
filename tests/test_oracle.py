"""Registered queries against DuckDB at the smallest scale.

A sample of the registry by default; KELPGRID_ALL=1 runs every query.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = """st_dbscan st_dbscan_partitioned neighbor_count eps_join cell_adjacency halo_assign point_zone merge_parts pareto_front hypervolume_history
convergence promising_region impute_failed parse_wkt_line parse_trial_log bench_job parse_run_log load_knob_catalog decile_bin zscore all_pairs fit_pair_knn
ranking_loss pair_loss_gradient vote_ranges anova_triple metric_series farthest_first""".split()
NAMES = [n for n in (entry.queries() if os.environ.get("KELPGRID_ALL") else SAMPLE) if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_registry_is_complete():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
