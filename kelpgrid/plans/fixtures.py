"""Views over the given tables that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgrid.functions import expressions as E
from kelpgrid.functions.ordering import with_row_number
from kelpgrid.session import configure

EPS_S, EPS_T, MIN_POINTS = 5.0, 300.0, 5
CELL = (50.0, 25.0, 2000.0)
PARTS, ALPHA = 8, 0.2

ORACLE_POINTS = """p AS (SELECT event_id AS id, value AS x, CAST(user_id AS DOUBLE) AS y,
 (epoch_us(ts) - 1704067200000000) / 1e8 AS t FROM events)"""

TRIAL_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]

ORACLE_TRIALS = """trials AS (SELECT l_returnflag AS task_id,
 row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS iter,
 l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_linestatus AS status,
 l_extendedprice AS f1, -l_quantity AS f2, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS trial_state,
 l_tax - 0.06 AS c1 FROM lineitem)"""

ORACLE_PART_TRIALS = """part_trials AS (SELECT p_brand AS task_id, p_partkey AS iter, p_size AS size, p_type AS kind,
 p_retailprice AS f1, -CAST(p_size AS DOUBLE) AS f2 FROM part)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"),
                    ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(1e8)).alias("t"))


def trials(spark: SparkSession, sf: str, numbered: bool = True) -> DataFrame:
    """lineitem as a run history: one task per return flag, iterations from 1 (if asked for)."""
    li = table(spark, sf, "lineitem").withColumn("task_id", F.col("l_returnflag"))
    rows = with_row_number(li, ["task_id"], TRIAL_KEY, "iter") if numbered else li
    return rows.select(
        "task_id", *(["iter"] if numbered else []), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("f1"),
        (-F.col("l_quantity")).alias("f2"), F.when(F.col("l_linenumber") == 7, 1).otherwise(0).alias("trial_state"),
        (F.col("l_tax") - 0.06).alias("c1"))


def part_trials(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("task_id"), F.col("p_partkey").alias("iter"), F.col("p_size").alias("size"),
        F.col("p_type").alias("kind"), F.col("p_retailprice").alias("f1"), (-F.col("p_size").cast("double")).alias("f2"))


# SQL counterparts of the expressions that DuckDB has no function for

def _horner(coefs: list[float], x: str) -> str:
    out = f"{coefs[0]:.17e}"
    for c in coefs[1:]:
        out = f"({out} * {x} + {c:.17e})"
    return out


def cdf_sql(z: str) -> str:
    """Normal distribution function of a name."""
    near = f"exp(-{z} * {z} / 2) * {_horner(E.CDF_NUM, f'abs({z})')} / {_horner(E.CDF_DEN, f'abs({z})')}"
    chain = f"(abs({z}) + 0.65e0)"
    for i in (4, 3, 2, 1):
        chain = f"(abs({z}) + {i}e0 / {chain})"
    upper = f"CASE WHEN abs({z}) > 37 THEN 0 WHEN abs({z}) < 7.07106781186547 THEN {near} ELSE exp(-{z} * {z} / 2) / {chain} / sqrt(2 * pi()) END"
    return f"(CASE WHEN {z} > 0 THEN 1 - ({upper}) ELSE {upper} END)"


def quantile_sql(p: str) -> str:
    """Normal quantile of a name strictly between 0 and 1."""
    q, tail = f"({p} - 0.5e0)", f"sqrt(-ln(least({p}, 1 - {p})))"
    mid = f"(0.180625e0 - {q} * {q})"
    far = f"{_horner(E.INV_FAR_NUM, f'({tail} - 1.6e0)')} / {_horner(E.INV_FAR_DEN, f'({tail} - 1.6e0)')}"
    end = f"{_horner(E.INV_END_NUM, f'({tail} - 5e0)')} / {_horner(E.INV_END_DEN, f'({tail} - 5e0)')}"
    return (f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {_horner(E.INV_MID_NUM, mid)} / {_horner(E.INV_MID_DEN, mid)} "
            f"ELSE sign({q}) * CASE WHEN {tail} <= 5 THEN {far} ELSE {end} END END)")


def unit_sql(key: str, tag: str) -> str:
    """``hash_unit`` of a text expression and a tag (text expression)."""
    return f"(CAST('0x' || substr(md5({key} || ':' || {tag}), 1, 12) AS BIGINT) / 281474976710656e0)"
