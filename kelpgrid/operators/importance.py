"""Importance of parameters: binned functional ANOVA, marginals, model-based attributions.

The variance decomposition is a binned estimator: every parameter is cut into
equal-width bins (or its categories), a cell's response is its mean, all cells
weigh the same, and variances are relative to the variance of the objective.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_left
from collections import Counter
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions.ordering import attach_row, quantiles
from kelpgrid.session import materialize

BINS = 32  # bins of a feature in boosted trees
DRAWN = 10_000  # rows from which boosted trees take their split points


def bin_params(df: DataFrame, numeric: dict[str, tuple[float, float]], bins: int = 10) -> DataFrame:
    """Replace numeric parameters by the number of their equal-width bin."""
    return df.withColumns({c: F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("string") for c, (lo, hi) in numeric.items()})


def _cell_variance(binned: DataFrame, sets: list[tuple[str, ...]], y: str) -> DataFrame:
    """Equal-weight variance of cell means of each parameter set, over the variance of y (one pass, grouping sets)."""
    cols = sorted({c for s in sets for c in s})
    cells = binned.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(
        F.avg(y).alias("m"), F.grouping_id().alias("gid"))
    name = None
    for s in sets:
        gid = sum(0 if c in s else 1 << (len(cols) - 1 - i) for i, c in enumerate(cols))
        label = F.lit(",".join(s))
        name = F.when(F.col("gid") == gid, label) if name is None else name.when(F.col("gid") == gid, label)
    total = binned.agg(F.var_pop(y)).scalar()
    v = cells.withColumn("params", name).groupBy("params").agg(F.var_pop("m").alias("v"))
    return v.select("params", F.try_divide("v", total).alias("v"))


def anova_main(binned: DataFrame, params: list[str], y: str) -> DataFrame:
    return _cell_variance(binned, [(p,) for p in params], y).withColumnRenamed("v", "share")


def _lower(params: tuple[str, ...]) -> list[str]:
    return [",".join(s) for k in range(1, len(params)) for s in combinations(params, k)]


def _interactions(binned: DataFrame, params: list[str], y: str, order: int) -> DataFrame:
    """Shares of all parameter sets up to ``order``: joint share minus the shares of the parts, at least 0."""
    sets = [s for k in range(1, order + 1) for s in combinations(sorted(params), k)]
    v = materialize(_cell_variance(binned, sets, y))
    out = v.filter(~F.col("params").contains(",")).withColumnRenamed("v", "share")
    for k in range(2, order + 1):
        parts = [(",".join(s), low) for s in combinations(sorted(params), k) for low in _lower(s)]
        link = v.sparkSession.createDataFrame(parts, "params string, part string")
        below = link.join(out.select(F.col("params").alias("part"), "share"), "part").groupBy("params").agg(F.sum("share").alias("below"))
        out = out.unionByName(v.join(below, "params").select("params", F.greatest(F.lit(0.0), F.col("v") - F.col("below")).alias("share")))
    return out.filter(F.size(F.split("params", ",")) == order)


def anova_pair(binned: DataFrame, params: list[str], y: str) -> DataFrame:
    return _interactions(binned, params, y, 2)


def anova_triple(binned: DataFrame, params: list[str], y: str) -> DataFrame:
    return _interactions(binned, params, y, 3)


def anova_cutoffs(df: DataFrame, y: str, low: float | None = None, high: float | None = None, percentiles: tuple[float, float] | None = None) -> DataFrame:
    """Map objective values outside the bounds (or percentiles) to the bound."""
    if percentiles:
        q = quantiles(df, [], y, {"__lo": percentiles[0], "__hi": percentiles[1]})
        return attach_row(df, q).withColumn(y, F.least(F.greatest(F.col(y), "__lo"), "__hi")).drop("__lo", "__hi")
    v = F.col(y)
    v = v if low is None else F.greatest(v, F.lit(low))
    return df.withColumn(y, v if high is None else F.least(v, F.lit(high)))


def marginal_curve(binned: DataFrame, param: str, y: str) -> DataFrame:
    return binned.groupBy(F.col(param).alias("bin")).agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.count(F.lit(1)).alias("n"))


def marginal_surface(binned: DataFrame, a: str, b: str, y: str) -> DataFrame:
    return binned.groupBy(F.col(a).alias("bin_a"), F.col(b).alias("bin_b")).agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"))


def input_checks(df: DataFrame, numeric: dict[str, tuple[float, float]], choices: dict[str, list[str]]) -> DataFrame:
    """Number of values out of bounds or of unknown category, per column."""
    bad: dict[str, Column] = {c: ~F.col(c).between(lo, hi) for c, (lo, hi) in numeric.items()}
    bad |= {c: ~F.col(c).isin(v) for c, v in choices.items()}
    one = df.agg(*[F.count_if(F.coalesce(b, F.lit(True))).alias(c) for c, b in bad.items()])
    return one.unpivot([], list(bad), "param", "violations")


def _features(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


def _drawn(df: DataFrame, share: float, seed: int) -> DataFrame:
    """The rows that Spark's trees draw to find split points."""
    spark = df.sparkSession
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    rows = df._jdf.toJavaRDD().sample(False, share, draw)
    return DataFrame(spark._jsparkSession.createDataFrame(rows, df._jdf.schema()), spark)


def _cuts(df: DataFrame, features: list[str], rows: int, seed: int) -> dict[str, list[float]]:
    """The split points Spark's trees take for ``rows`` rows: between values, or near equal numbers of rows if there are more values than bins.

    Spark looks at all rows up to ``DRAWN`` and draws about as many of more; what the draw falls short of counts as zeros.
    """
    share = min(1.0, DRAWN / max(rows, 1))
    values = df.select(*features)
    found = (_drawn(values, share, seed) if share < 1 else values).collect()
    expected, most, cuts = share * rows, min(BINS, rows) - 1, {}
    for c in features:
        counts: dict[float, float] = Counter(r[c] for r in found if r[c] is not None and r[c] == r[c] and r[c] != 0.0)
        total = sum(counts.values())
        if counts and expected - total > sys.float_info.epsilon * total * 100:
            counts[0.0] = expected - total
        order = sorted(counts.items())
        cuts[c] = [(x + y) / 2.0 for (x, _), (y, _) in zip(order, order[1:])]
        if len(cuts[c]) > most:
            between, cuts[c], stride, before = cuts[c], [], expected / (most + 1), 0.0
            want = stride
            for (_, n), (_, after), cut in zip(order, order[1:], between):
                before += n
                if abs(before - want) < abs(before + after - want):
                    cuts[c].append(cut)
                    want += stride
    return cuts


def _bin(c: str, cuts: list[float]) -> Column:
    """Number of split points below a value; no value has no bin, which ends the job in the assembler."""
    points = F.array(*[F.lit(x) for x in cuts]).cast("array<double>")
    return F.when(F.col(c).isNotNull() & ~F.isnan(c), F.size(F.filter(points, lambda x: x < F.col(c))).cast("double"))


def positive_attribution(df: DataFrame, features: list[str], y: str, seed: int = 1) -> DataFrame:
    """Mean positive effect of each parameter on the negated objective under boosted trees.

    The effect of a parameter in a row is the change of the prediction when the
    parameter is set to its mean.

    Trees see a feature only through its at most ``BINS`` bins, and squared errors only through the number and
    mean of the objectives, so rows in the same bins are one weighted row, in the trees and in the effects.
    """
    df = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in features], (-F.col(y)).alias("__y")))
    whole = df.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(f"mean_{c}") for c in features]).first()
    cuts = _cuts(df, features, whole["rows"], seed)
    label = F.col("__y").cast("double")
    valid = label.isNotNull() & ~F.isnan(label) & (F.abs(label) < float("inf"))
    label = F.when(valid, label).otherwise(F.raise_error(F.lit("the objective is null, NaN or infinite")).cast("double"))
    binned = df.select(*[_bin(c, cuts[c]).alias(c) for c in features], label.alias("__y"))
    rows = materialize(binned.groupBy(*features).agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg("__y").alias("__y")))
    # Split points between bins are looked for on a sample of more rows than the square of maxBins.
    most = max(BINS, math.ceil(math.sqrt(min(rows.count(), 1_000_000))))
    model = GBTRegressor(labelCol="__y", weightCol="__n", maxIter=20, maxDepth=4, maxBins=most, seed=seed, predictionCol="__full").fit(_features(rows, features))
    base = materialize(model.transform(_features(rows, features)).drop("features"))
    out = None
    for c in features:
        changed = _features(base.withColumn(c, F.lit(float(bisect_left(cuts[c], whole[f"mean_{c}"])))), features)
        p = model.setPredictionCol("__alt").transform(changed)
        positive = F.greatest(F.lit(0.0), F.col("__full") - F.col("__alt"))
        effect = p.agg((F.sum(positive * F.col("__n")) / F.sum("__n")).alias("attribution")).select(F.lit(c).alias("param"), "attribution")
        out = effect if out is None else out.unionByName(effect)
    return out


def forest_importance(df: DataFrame, features: list[str], y: str, seed: int = 1) -> DataFrame:
    """Impurity importances of a random forest."""
    model = RandomForestRegressor(labelCol=y, numTrees=30, maxDepth=6, seed=seed).fit(_features(df, features))
    rows = [(c, float(v)) for c, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "param string, importance double")


def top_knobs(importance: DataFrame, n: int, by: str = "importance") -> DataFrame:
    return importance.orderBy(F.col(by).desc(), "param").limit(n)


def knob_schedule(trials: DataFrame, mode: str, init: int, every: int, first: int, most: int) -> DataFrame:
    """Number of tuned knobs per iteration: growing in steps up to ``most``, or shrinking by 0.6 down to 5."""
    step = F.floor(F.greatest(F.col("iter") - first, F.lit(0)) / every)
    n = F.least(F.lit(init) + step * every, F.lit(most)) if mode == "increase" else F.greatest(F.floor(F.lit(float(init)) * F.pow(F.lit(0.6), step)), F.lit(5))
    return trials.withColumn("n_knobs", n.cast("long"))
