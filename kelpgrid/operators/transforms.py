"""Column transforms, imputation and preparation of run tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions.expressions import normal_quantile
from kelpgrid.functions.ordering import attach_row, quantiles, with_group_stats, with_row_number

STD_FLOOR = 1e-4

# Positions dropped when 65 internal metrics are reduced to 51.
EXTRA_METRICS = [11, 12, 15, 37, 40, 43, 47, 48, 49, 50, 51, 62, 63, 64]
# Unit suffixes of memory and size knobs.
UNITS = "gmk"


def scale_01(x: Column, lo: Column, hi: Column) -> Column:
    """Null where the column is constant."""
    return F.try_divide(x - lo, hi - lo)


def unscale_01(u: Column, lo: Column, hi: Column) -> Column:
    return lo + (hi - lo) * u


def with_scaled(df: DataFrame, cols: list[str], keys: list[str] = (), suffix: str = "_s") -> DataFrame:
    """Min-max scaled copies of numeric columns, per group or over the table."""
    stats = {f"__{e}_{c}": f(c) for c in cols for e, f in (("lo", F.min), ("hi", F.max))}
    out = with_group_stats(df, list(keys), **stats)
    return out.withColumns({c + suffix: scale_01(F.col(c), F.col(f"__lo_{c}"), F.col(f"__hi_{c}")) for c in cols}).drop(*stats)


def scale_pm1(u: Column) -> Column:
    """[0, 1] -> [-1, 1]."""
    return u * 2 - 1


def with_zscore(df: DataFrame, col: str, keys: list[str] = (), out: str = "z", keep_stats: bool = False) -> DataFrame:
    """(x - mean) / (population deviation + 1e-4)."""
    t = with_group_stats(df, list(keys), z_mean=F.avg(col), z_std=F.stddev_pop(col) + F.lit(STD_FLOOR))
    t = t.withColumn(out, (F.col(col) - F.col("z_mean")) / F.col("z_std"))
    return t if keep_stats else t.drop("z_mean", "z_std")


def zscore_guard(df: DataFrame, col: str, keys: list[str], order: str) -> DataFrame:
    """In a constant group the first value is raised by 1e-4, so that a deviation exists."""
    t = with_group_stats(df, keys, __lo=F.min(col), __hi=F.max(col), __first=F.min(order))
    nudge = (F.col("__lo") == F.col("__hi")) & (F.col(order) == F.col("__first"))
    return t.withColumn(col, F.when(nudge, F.col(col) + F.lit(1e-4)).otherwise(F.col(col))).drop("__lo", "__hi", "__first")


def gaussian_rank(df: DataFrame, col: str, keys: list[str], tie: str, out: str = "g") -> DataFrame:
    """Rank / (n - 1), clipped to [d, 1 - d] with d = 1 / (4 n^0.25 sqrt(pi ln n)), then the normal quantile."""
    t = with_row_number(df, keys, [col, tie], "__rn")
    t = with_group_stats(t, keys, __n=F.count(F.lit(1)))
    n = F.col("__n").cast("double")
    delta = F.try_divide(F.lit(1.0), F.lit(4.0) * F.pow(n, 0.25) * F.sqrt(F.lit(math.pi) * F.log(n)))
    t = t.withColumn("clipped", F.least(F.greatest(F.try_divide(F.col("__rn") - 1, n - 1), delta), 1 - delta))
    return t.withColumn(out, normal_quantile(F.col("clipped"))).drop("__rn", "__n")


def decile_points(df: DataFrame, col: str, keys: list[str] = ()) -> DataFrame:
    """The nine inner deciles d1..d9 (the tenth is infinity)."""
    return quantiles(df, list(keys), col, {f"d{i}": i / 10 for i in range(1, 10)})


def decile_bin(x: Column, start: int = 0) -> Column:
    """start + index of the first decile >= x; expects columns d1..d9."""
    out = F.when(x <= F.col("d1"), start)
    for i in range(2, 10):
        out = out.when(x <= F.col(f"d{i}"), start + i - 1)
    return out.otherwise(start + 9)


def strip_unit(c: str) -> Column:
    return F.regexp_replace(F.col(c).cast("string"), f"[{UNITS}]$", "").try_cast("double")


def add_unit(c: str, unit: str) -> Column:
    return F.concat(F.col(c).cast("long").cast("string"), F.lit(unit))


def bool_flag(c: str) -> Column:
    return F.when(F.col(c) == "True", 1).otherwise(0)


def levels(df: DataFrame, col: str, bound: int = 1000) -> list[str]:
    """Sorted levels of a categorical knob; refuses columns that are no category."""
    found = [row[0] for row in df.select(col).distinct().orderBy(col).limit(bound + 1).collect()]
    if len(found) > bound:
        raise ValueError(f"{col} has more than {bound} levels")
    return found


def one_hot(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """One 0/1 column per level, in sorted order; the source column is dropped."""
    return df.withColumns({f"{col}_{v}": F.when(F.col(col) == v, 1.0).otherwise(0.0) for v in values}).drop(col)


def coerce_result(df: DataFrame, col: str = "result") -> DataFrame:
    """Rows with a numeric result, as an integer."""
    return df.withColumn(col, F.col(col).try_cast("double").cast("long")).dropna(subset=[col])


def prepare_runs(df: DataFrame, units: list[str], flags: list[str], category: str, drop: list[str] = ()) -> DataFrame:
    """Numeric result, plain sizes, 0/1 switches, one-hot codec."""
    out = coerce_result(df).drop(*drop)
    out = out.withColumns({c: strip_unit(c) for c in units} | {c: bool_flag(c) for c in flags})
    return one_hot(out, category, levels(out, category))


def impute_mean_minmax(known: DataFrame, new: DataFrame, cols: list[str]) -> DataFrame:
    """Means fill gaps; min and max of the known rows scale the new ones, clipped to [0, 1]."""
    stats = known.agg(*[f(c).alias(f"__{e}_{c}") for c in cols for e, f in (("m", F.avg), ("lo", F.min), ("hi", F.max))])
    t = attach_row(new, stats)
    scaled = {}
    for c in cols:
        x = F.coalesce(F.col(c), F.col(f"__m_{c}"))
        scaled[c] = F.least(F.lit(1.0), F.greatest(F.lit(0.0), scale_01(x, F.col(f"__lo_{c}"), F.col(f"__hi_{c}"))))
    return t.withColumns(scaled).drop(*stats.columns)


def impute_nonfinite(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    def fix(c, d):
        x = F.col(c)
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        return F.when(bad, F.lit(d)).otherwise(x)
    return df.withColumns({c: fix(c, d) for c, d in defaults.items()})


def impute_from_incumbent(df: DataFrame, incumbent: DataFrame, cols: list[str]) -> DataFrame:
    """Missing knobs take the value of the one best row."""
    t = attach_row(df, incumbent.select(*[F.col(c).alias(f"__i_{c}") for c in cols]))
    return t.withColumns({c: F.coalesce(F.col(c), F.col(f"__i_{c}")) for c in cols}).drop(*[f"__i_{c}" for c in cols])


def clip_to_space(df: DataFrame, bounds: dict[str, tuple[float, float]], choices: dict[str, tuple[list[str], str]], keep: list[str]) -> DataFrame:
    """Numbers into their bounds, unknown categories to the default, foreign knobs dropped."""
    out = {c: F.least(F.lit(hi), F.greatest(F.lit(lo), F.col(c))) for c, (lo, hi) in bounds.items()}
    out |= {c: F.when(F.col(c).isin(allowed), F.col(c)).otherwise(F.lit(default)) for c, (allowed, default) in choices.items()}
    return df.select(*keep, *[e.alias(c) for c, e in out.items()])


def configs_to_table(df: DataFrame, col: str, knobs: list[str], keep: list[str]) -> DataFrame:
    """Map column -> one column per knob."""
    return df.select(*keep, *[F.try_element_at(F.col(col), F.lit(k)).alias(k) for k in knobs])


def active_params(df: DataFrame, conditions: list[tuple[str, str, list]]) -> DataFrame:
    """(child, parent, values): the child is null unless the parent has one of the values."""
    return df.withColumns({child: F.when(F.col(parent).isin(values), F.col(child)) for child, parent, values in conditions})


def forbidden_filter(df: DataFrame, clauses: list[list[tuple[str, list]]]) -> DataFrame:
    """Drop rows that match all terms of any clause; a term is (column, forbidden values)."""
    hit = F.lit(False)
    for clause in clauses:
        term = F.lit(True)
        for c, values in clause:
            term = term & F.coalesce(F.col(c).isin(values), F.lit(False))
        hit = hit | term
    return df.filter(~hit)


def drop_metrics(metrics: Column) -> Column:
    """65 internal metrics -> 51; an array of 51 stays as it is."""
    gone = F.array(*[F.lit(i) for i in EXTRA_METRICS])
    return F.when(F.size(metrics) == 51, metrics).otherwise(F.filter(metrics, lambda _, i: ~F.array_contains(gone, i)))


def param_bounds(catalog: DataFrame) -> DataFrame:
    """Type code and bounds per parameter: categories count their values, numbers live on [0, 1]."""
    n = F.size("choices")
    return catalog.select(
        "name", F.when(F.col("type") == "enum", n).otherwise(0).alias("code"),
        F.when(F.col("type") == "enum", n.cast("double")).otherwise(0.0).alias("low"),
        F.when(F.col("type").isin("integer", "float"), 1.0).alias("high"))


def space_size(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """log10 of the product of sizes: categories count values, spans over 10,000 count as 10,000 (at least 1).

    Spans up to 10,000 are left out.  The product is kept as a logarithm so that
    many knobs cannot overflow; an empty product has no value.
    """
    span = F.col("max") - F.col("min")
    steps = F.when(F.col("type") == "integer", span + 1).otherwise(F.lit(None))
    size = F.when(F.col("type") == "enum", F.size("choices").cast("double")).when(
        (span > 10000) & steps.isNotNull(), F.greatest(F.lit(1.0), steps / span * 10000))
    return catalog.groupBy(*keys).agg(F.sum(F.log10(size)).alias("log10_size"))


def space_features(catalog: DataFrame, keys: list[str]) -> DataFrame:
    cat = F.avg((F.col("type") == "enum").cast("double"))
    return catalog.groupBy(*keys).agg(F.count(F.lit(1)).alias("knobs"), (1 - cat).alias("numeric_share"), cat.alias("categorical_share"))
