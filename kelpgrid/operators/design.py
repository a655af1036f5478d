"""Candidate tables: designs over a space, acquisition scores, surrogate fit."""

from __future__ import annotations

import random

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions.expressions import hash_unit, normal_cdf, normal_pdf
from kelpgrid.functions.ordering import with_row_number
from kelpgrid.operators.nearest import nearest_k
from kelpgrid.session import materialize

SOBOL_BITS = 30
# Primitive polynomials (degree, coefficients) and initial direction
# numbers of the Sobol sequence for dimensions 2..8 (published Joe-Kuo table).
SOBOL_TABLE = [
    (1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]),
    (4, 1, [1, 1, 3, 3]), (4, 4, [1, 3, 5, 13]), (5, 2, [1, 1, 5, 5, 17]),
]


def _knob(k: dict, u: Column) -> Column:
    """Value of a knob at position u in [0, 1)."""
    if k["type"] == "enum":
        return F.element_at(F.array(*[F.lit(c) for c in k["choices"]]), (F.floor(u * len(k["choices"])) + 1).cast("int"))
    if k["type"] == "integer":
        return F.lit(int(k["low"])) + F.floor(u * F.lit(int(k["high"]) - int(k["low"]) + 1))
    return F.lit(float(k["low"])) + u * F.lit(float(k["high"]) - float(k["low"]))


def random_design(base: DataFrame, space: list[dict], seed: int, key: str = "row") -> DataFrame:
    """One uniform configuration per row of ``base`` (use ``spark.range(n)`` for n rows); draws depend on key and seed alone."""
    return base.select(key, *[_knob(k, hash_unit(F.col(key), f"{seed}:{i}")).alias(k["name"]) for i, k in enumerate(space)])


def random_design_distinct(base: DataFrame, space: list[dict], seen: DataFrame, n: int, seed: int) -> DataFrame:
    """n distinct configurations that are not in ``seen``; redrawn until there are n, an error once draws bring nothing new."""
    names = [k["name"] for k in space]
    found, before, idle, t = None, 0, 0, 0
    while True:
        draw = random_design(base, space, seed + 1000 * t).select(*names)
        draw = draw if found is None else found.unionByName(draw)
        found = materialize(draw.distinct().join(seen.select(*names), names, "left_anti"))
        have = found.count()
        if have >= n:
            break
        idle = idle + 1 if have == before else 0
        if idle == 5:
            raise ValueError(f"only {have} of {n} distinct configurations found")
        before, t = have, t + 1
    return found.orderBy(F.md5(F.concat_ws(":", *names)), *names).limit(n)


def lhs_design(base: DataFrame, dims: int, seed: int, key: str = "row", criterion: str | None = None, draws: int = 4) -> DataFrame:
    """Latin hypercube: every dimension has one point in each of n strata.

    With a criterion several draws are made; ``correlation`` keeps the one with
    the smallest largest pairwise correlation, ``maximin`` the one with the
    largest smallest distance, ``ratio`` the smallest ratio of largest to
    smallest nearest distance.
    """
    best, best_score = None, None
    n = base.count()
    for d in range(draws if criterion else 1):
        spots = [F.struct(F.lit(i).alias("dim"), hash_unit(F.col(key), f"{seed}:{d}:r{i}").alias("r"), hash_unit(F.col(key), f"{seed}:{d}:j{i}").alias("j"))
                 for i in range(dims)]
        t = materialize(base.select(key, F.inline(F.array(*spots))))
        t = with_row_number(t, ["dim"], ["r", key], "s").withColumn("u", (F.col("s") - F.col("j")) / n)
        t = materialize(t.groupBy(key).agg(*[F.max(F.when(F.col("dim") == i, F.col("u"))).alias(f"u{i}") for i in range(dims)]))
        if criterion is None:
            return t
        u = [f"u{i}" for i in range(dims)]
        if criterion == "correlation":
            row = t.agg(*[F.abs(F.corr(a, b)) for i, a in enumerate(u) for b in u[:i]]).first()
            score = -max(v or 0.0 for v in row)
        else:
            near = nearest_k(t, t, key, u, 1, other_key=key).agg(F.min("distance"), F.max("distance")).first()
            score = near[0] if criterion == "maximin" else -near[1] / max(near[0], 1e-12)
        if best_score is None or score > best_score:
            best, best_score = t, score
    return best


def _times_x(a: int, poly: int, degree: int) -> int:
    a <<= 1
    return a ^ poly if a >> degree else a


def _product(a: int, b: int, poly: int, degree: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = _times_x(a, poly, degree), b >> 1
    return out


def _power_of_x(n: int, poly: int, degree: int) -> int:
    out, x = 1, _times_x(1, poly, degree)
    while n:
        if n & 1:
            out = _product(out, x, poly, degree)
        x, n = _product(x, x, poly, degree), n >> 1
    return out


def primitive_polynomials(degree: int) -> list[int]:
    """Inner coefficients of the primitive polynomials of a degree over two elements: those in which x has order 2^degree - 1."""
    order = (1 << degree) - 1
    primes, rest = [], order
    for q in range(2, order + 1):
        if rest % q == 0:
            primes.append(q)
            while rest % q == 0:
                rest //= q
        if rest == 1:
            break
    found = []
    for inner in range(1 << (degree - 1)):
        poly = 1 << degree | inner << 1 | 1
        if _power_of_x(order, poly, degree) == 1 and all(_power_of_x(order // q, poly, degree) != 1 for q in primes):
            found.append(inner)
    return found


def sobol_polynomial(dim: int) -> tuple[int, int, list[int]]:
    """Degree, inner coefficients and first direction numbers of dimension ``dim``, from 1 on.

    Dimensions of the published table take theirs from it.  The others take the next primitive
    polynomials by degree and value; their first numbers are odd, as the sequence needs, and drawn by a fixed rule.
    """
    if dim <= len(SOBOL_TABLE):
        return SOBOL_TABLE[dim - 1]
    degree, left = 1, dim - 1
    while left >= len(found := primitive_polynomials(degree)):
        degree, left = degree + 1, left - len(found)
    draw = random.Random(dim)
    return degree, found[left], [draw.getrandbits(i) << 1 | 1 if i else 1 for i in range(degree)]


def _directions(dim: int) -> list[int]:
    """Direction numbers of one dimension, by the usual recurrence."""
    if dim == 0:
        return [1 << (SOBOL_BITS - 1 - i) for i in range(SOBOL_BITS)]
    degree, coeff, m = sobol_polynomial(dim)
    v = [m[i] << (SOBOL_BITS - 1 - i) for i in range(degree)]
    for i in range(degree, SOBOL_BITS):
        x = v[i - degree] ^ (v[i - degree] >> degree)
        for k in range(1, degree):
            if coeff >> (degree - 1 - k) & 1:
                x ^= v[i - k]
        v.append(x)
    return v


def sobol_design(base: DataFrame, dims: int, seed: int | None, key: str = "row") -> DataFrame:
    """Sobol points, one per row, of any number of dimensions; ``seed`` adds a digital shift."""
    shift = random.Random(seed)
    t = with_row_number(base.select(key), [], [key], "__n").withColumn("__i", F.col("__n") - 1)
    gray = F.col("__i").bitwiseXOR(F.shiftright("__i", 1))
    t = t.withColumn("__g", gray)
    cols = []
    for d in range(dims):
        x = F.lit(shift.getrandbits(SOBOL_BITS) if seed is not None else 0).cast("long")
        for b, v in enumerate(_directions(d)):
            x = x.bitwiseXOR(F.shiftright("__g", b).bitwiseAND(F.lit(1).cast("long")) * F.lit(v).cast("long"))
        cols.append((x / F.lit(float(1 << SOBOL_BITS))).alias(f"u{d}"))
    return t.select(key, *cols)


def bounded_design(df: DataFrame, bounds: dict[str, tuple[float, float]], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[(F.lit(lo) + F.col(c) * F.lit(hi - lo)).alias(c) for c, (lo, hi) in bounds.items()])


def farthest_first(candidates: DataFrame, key: str, dims: list[str], start: dict[str, float], n: int) -> DataFrame:
    """Start at the default, repeatedly add the candidate farthest from all picked so far.

    Every round is one aggregate over the candidates; only the picked points
    (n rows) come to the driver.
    """
    def distance(p):
        d2 = F.lit(0.0)
        for d in dims:
            d2 = d2 + (F.col(d) - F.lit(p[d])) * (F.col(d) - F.lit(p[d]))
        return F.sqrt(d2)

    near = distance(start)
    picked = []
    for i in range(n):
        row = candidates.withColumn("__near", near).agg(F.max_by(
            F.struct(key, *dims, "__near"), F.struct(F.col("__near"), -F.col(key))).alias("p")).first()["p"]
        if row is None:
            break
        picked.append((i + 1, row[key], float(row["__near"])))
        near = F.least(near, distance(row.asDict()))
    return candidates.sparkSession.createDataFrame(picked, f"pick int, {key} long, distance double")


def initial_design(base: DataFrame, space: list[dict], default: dict, strategy: str, seed: int, n: int) -> DataFrame:
    """random / default_random / explore_first / sobol / lhs over numeric spaces."""
    names = [k["name"] for k in space]
    if strategy in ("sobol", "lhs"):
        unit = sobol_design(base, len(space), seed) if strategy == "sobol" else lhs_design(base, len(space), seed)
        return unit.select(*[_knob(k, F.col(f"u{i}")).alias(k["name"]) for i, k in enumerate(space)])
    rows = random_design(base, space, seed)
    if strategy == "random":
        return rows.select(*names)
    first = base.sparkSession.createDataFrame([tuple(default[c] for c in names)], rows.select(*names).schema)
    if strategy == "default_random":
        return first.unionByName(rows.select(*names))
    rows = materialize(rows)
    picks = farthest_first(rows, "row", names, {c: float(default[c]) for c in names}, n - 1)
    return first.unionByName(rows.join(picks, "row").select(*names))


def score_lcb(mu: str, sigma: str, kappa: float = 1.96) -> Column:
    return F.col(mu) - kappa * F.col(sigma)


def score_ei(mu: str, sigma: str, y_opt: Column, xi: float = 0.01) -> Column:
    """Negative expected improvement (smaller is better)."""
    gain = y_opt - xi - F.col(mu)
    z = F.try_divide(gain, F.col(sigma))
    return F.when(F.col(sigma) > 0, -(gain * normal_cdf(z) + F.col(sigma) * normal_pdf(z))).otherwise(0.0)


def score_pi(mu: str, sigma: str, y_opt: Column, xi: float = 0.01) -> Column:
    """Negative probability of improvement."""
    return F.when(F.col(sigma) > 0, -normal_cdf(F.try_divide(y_opt - xi - F.col(mu), F.col(sigma)))).otherwise(0.0)


def top_candidates(scored: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return scored.orderBy(score, key).limit(k)


def hedge_weights(gains: DataFrame) -> DataFrame:
    """``gains(acq, mu)``: softmax of the accumulated negative predictions."""
    g = gains.groupBy("acq").agg(F.sum(-F.col("mu")).alias("gain"))
    top = g.agg(F.max("gain")).scalar()
    e = g.withColumn("e", F.exp(F.col("gain") - top))
    return e.select("acq", (F.col("e") / e.agg(F.sum("e")).scalar()).alias("weight"))


def fit_regressor(df: DataFrame, features: list[str], y: str, seed: int = 3, trees: int = 20, depth: int = 3) -> DataFrame:
    """Boosted trees for result ~ parameters; returns the rows with their prediction."""
    data = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    model = GBTRegressor(labelCol=y, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed).fit(data)
    return model.transform(data).drop("features")
