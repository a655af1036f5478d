"""Bounding cubes, grid cells, cell graph, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions.expressions import hash_unit
from kelpgrid.functions.ordering import attach_row, long_table, with_row_number

AXES = ("x", "y", "t")
SAMPLE_SEED = 9961


def sample_fraction(df: DataFrame, fraction: float, key: str = "id", seed: int = SAMPLE_SEED) -> DataFrame:
    """Bernoulli sample without replacement, the same rows for any partitioning."""
    return df.filter(hash_unit(F.col(key), str(seed)) < fraction)


def sample_n(df: DataFrame, n: int, key: str = "id", seed: int = SAMPLE_SEED) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), the same ones for any partitioning.

    The hash order makes this a distributed top-n: every task keeps n rows.
    """
    tag = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(tag, key).limit(n)


def bounding_cube(points: DataFrame) -> DataFrame:
    return points.agg(*[f(a).alias(f"{a}{n}") for a in AXES for n, f in (("0", F.min), ("1", F.max))])


def cube_contains_point(cube: str = "") -> Column:
    """Closed on all faces; cube columns x0..t1, point columns x, y, t."""
    return _all(F.col(a).between(F.col(f"{cube}{a}0"), F.col(f"{cube}{a}1")) for a in AXES)


def cube_almost_contains(cube: str = "") -> Column:
    """Open on all faces."""
    return _all((F.col(f"{cube}{a}0") < F.col(a)) & (F.col(a) < F.col(f"{cube}{a}1")) for a in AXES)


def cube_contains_cube(outer: str, inner: str) -> Column:
    return _all((F.col(f"{outer}{a}0") <= F.col(f"{inner}{a}0")) & (F.col(f"{inner}{a}1") <= F.col(f"{outer}{a}1")) for a in AXES)


def cube_shrink(df: DataFrame, space: float, time: float, prefix: str = "") -> DataFrame:
    """Inset a cube on every side; negative amounts expand it."""
    by = {"x": space, "y": space, "t": time}
    return df.withColumns({f"{prefix}{a}0": F.col(f"{prefix}{a}0") + by[a] for a in AXES}
                          | {f"{prefix}{a}1": F.col(f"{prefix}{a}1") - by[a] for a in AXES})


def _all(conds) -> Column:
    out = None
    for c in conds:
        out = c if out is None else out & c
    return out


def grid_cells(points: DataFrame, cell: tuple[float, float, float], origin: DataFrame | None = None) -> DataFrame:
    """Half-open cell coordinates (cx, cy, ct) counted from the smallest corner."""
    corner = (origin if origin is not None else bounding_cube(points)).select("x0", "y0", "t0")
    out = attach_row(points, corner)
    return out.withColumns({f"c{a}": F.floor((F.col(a) - F.col(f"{a}0")) / F.lit(size)) for a, size in zip(AXES, cell)}
                           ).drop("x0", "y0", "t0")


def cell_histogram(cells: DataFrame) -> DataFrame:
    """Points per non-empty cell with dense ids from 1 in (cx, cy, ct) order."""
    counts = cells.groupBy("cx", "cy", "ct").agg(F.count(F.lit(1)).alias("n"))
    return with_row_number(counts, [], ["cx", "cy", "ct"], "cell_id")


def cell_cubes(hist: DataFrame, corner: DataFrame, cell: tuple[float, float, float]) -> DataFrame:
    """Histogram rows with the six bounds of their cube."""
    out = attach_row(hist, corner.select(*[F.col(f"{a}0").alias(f"__{a}") for a in AXES]))
    for a, size in zip(AXES, cell):
        low = F.col(f"__{a}") + F.col(f"c{a}") * F.lit(size)
        out = out.withColumns({f"{a}0": low, f"{a}1": low + F.lit(size)})
    return out.drop("__x", "__y", "__t")


def cell_adjacency(hist: DataFrame) -> DataFrame:
    """Edges (src < dst) between cells at most one step apart, weight sqrt(n1 * n2).

    Only the 13 forward neighbours are generated; each finds its cell by key.
    """
    forward = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in forward])
    a = hist.select(F.col("cell_id").alias("src"), F.col("n").alias("n1"), "cx", "cy", "ct", F.explode(steps).alias("s"))
    a = a.select("src", "n1", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"),
                 (F.col("ct") + F.col("s.k")).alias("ct"))
    b = hist.select(F.col("cell_id").alias("dst"), F.col("n").alias("n2"), "cx", "cy", "ct")
    return a.join(long_table(b), ["cx", "cy", "ct"]).select(
        "src", "dst", F.sqrt(F.col("n1").cast("double") * F.col("n2")).alias("w"))


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def isolated_cells(hist: DataFrame, edges: DataFrame) -> DataFrame:
    touched = edges.select(F.col("src").alias("cell_id")).unionByName(edges.select(F.col("dst").alias("cell_id")))
    return hist.join(touched, "cell_id", "left_anti")
