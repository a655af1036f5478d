"""Nearest rows of a table for each candidate, by rings of grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.functions.ordering import long_table
from kelpgrid.session import materialize


def _square(dims):
    out = F.lit(0.0)
    for d in dims:
        out = out + (F.col(d) - F.col(f"e_{d}")) * (F.col(d) - F.col(f"e_{d}"))
    return out


def nearest_k(candidates: DataFrame, evaluated: DataFrame, key: str, dims: list[str], k: int,
              payload: list[str] = (), other_key: str | None = None, order: str | None = None) -> DataFrame:
    """The k closest rows of ``evaluated``: ``(key, distance, *payload)``.

    Round by round the cell edge doubles.  A candidate looks at the cells around
    its own; when its k-th distance is no larger than the edge the answer is
    final, because nothing outside those cells can be closer.  Of equal rows only
    k can matter, so copies are reduced before the search.  ``other_key`` names
    the key of ``evaluated`` when a row must not be its own neighbour; ``order``
    breaks ties.
    """
    extra = list(dict.fromkeys([*payload, *([order] if order else [])]))
    ev = evaluated.select(*[F.col(d).cast("double").alias(f"e_{d}") for d in dims],
                          *([F.col(other_key).alias("__ok")] if other_key else []), *[F.col(c).alias(f"p_{c}") for c in extra])
    coords = [f"e_{d}" for d in dims]
    tie = f"p_{order}" if order else ("__ok" if other_key else coords[0])
    copies = Window.partitionBy(*coords).orderBy(tie)
    ev = ev.withColumn("__c", F.row_number().over(copies)).filter(F.col("__c") <= k + (1 if other_key else 0)).drop("__c")
    ev = materialize(ev)
    size = ev.agg(F.count(F.lit(1)), *[F.max(c) - F.min(c) for c in coords], *[F.max(F.abs(c)) for c in coords]).first()
    n, m = size[0], len(dims)
    left = materialize(candidates.select(key, *[F.col(d).cast("double").alias(d) for d in dims]))
    reach = left.agg(*[F.max(F.abs(d)) for d in dims]).first()
    span = max([float(v or 0.0) for v in size[1:1 + m]] + [1e-12])
    whole = 2 * max([span] + [float(v or 0.0) for v in size[1 + m:]] + [float(v or 0.0) for v in reach])
    edge = span / max(1.0, n ** (1.0 / m)) / 2
    done = None
    while True:
        c, e = left, ev
        for d in dims:
            cell = F.floor(F.col(d) / F.lit(edge))
            c = c.select("*", F.explode(F.array(cell - 1, cell, cell + 1)).alias(f"k_{d}"))
            e = e.withColumn(f"k_{d}", F.floor(F.col(f"e_{d}") / F.lit(edge)))
        near = c.join(long_table(e), [f"k_{d}" for d in dims])
        if other_key:
            near = near.filter(F.col(key) != F.col("__ok"))
        near = near.withColumn("distance", F.sqrt(_square(dims))).select(key, "distance", tie, *[f"p_{x}" for x in extra if f"p_{x}" != tie])
        rank = Window.partitionBy(key).orderBy("distance", tie)
        top = near.withColumn("__k", F.row_number().over(rank)).filter(F.col("__k") <= k)
        top = materialize(top.select(key, "distance", *[F.col(f"p_{x}").alias(x) for x in payload]))
        full = top.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        last = edge > whole
        ok = full.filter((F.col("n") >= k) & (F.col("far") <= F.lit(edge * (1 - 1e-9)))) if not last else full
        final = top.join(ok.select(key), key, "left_semi")
        done = final if done is None else done.unionByName(final)
        left = materialize(left.join(ok, key, "left_anti"))
        if last or left.isEmpty():
            return done
        edge *= 2


def nearest_distance(candidates: DataFrame, evaluated: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """``(key, distance)`` to the closest row of ``evaluated``."""
    return nearest_k(candidates, evaluated, key, dims, 1)
