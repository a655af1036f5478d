"""Whitening of embeddings by principal components found through contour integration.

The covariance is summed in tasks, centred before multiplying, and is as large as the
number of dimensions squared, whatever the number of rows.  Its spectrum is cut into
intervals of a few eigenvalues by inertia counts of shifted covariances.  Each interval is
a task of its own (FEAST): the contour around it is integrated by quadrature, one complex
shifted solve for each node, which projects a random block onto the interval's eigenvectors;
Rayleigh-Ritz extracts them, and the block is filtered again until residuals stop falling.
An interval counts as solved only with as many eigenvalues as its inertia counts say, so
none is missed.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgrid.llm.vectors import common_length, exact_sums, matrix, rows_of, scaled, summed_matrix, usable
from kelpgrid.session import materialize

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
BOUND = float(1 << 40)  # of an entry; beyond it 64 * c may not be exact
NODES = 8  # of the quadrature on half a contour
PER_INTERVAL = 8
FLAT = 1e-12  # of the trace: eigenvalues below are rounding
WIDE = 38  # digits of an exact deviation


def above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of symmetric ``v`` above ``shift``: positive pivots of a symmetric elimination with 1 x 1 and 2 x 2 pivots."""
    a = v - shift * np.eye(len(v))
    live, count = len(a), 0
    while live:
        b = a[:live, :live]
        diagonal = np.abs(np.diagonal(b))
        p = int(diagonal.argmax())
        off = np.abs(b - np.diag(np.diagonal(b)))
        q, r = divmod(int(off.argmax()), live)
        if diagonal[p] == 0 and off[q, r] == 0:
            break
        single = diagonal[p] >= 0.64 * off[q, r]
        for k, at in enumerate([p] if single else sorted((q, r), reverse=True), 1):
            a[[at, live - k], :live] = a[[live - k, at], :live]
            a[:live, [at, live - k]] = a[:live, [live - k, at]]
        if single:
            live -= 1
            pivot, side = a[live, live], a[:live, live].copy()
            count += int(pivot > 0)
            a[:live, :live] -= np.outer(side, side / pivot)
        else:
            live -= 2
            block, side = a[live:live + 2, live:live + 2].copy(), a[:live, live:live + 2].copy()
            count += 1  # the determinant is negative: one of each sign
            a[:live, :live] -= side @ np.linalg.solve(block, side.T)
    return count


def _between(v: np.ndarray, edge: float, low: float, high: float, steps: int = 24) -> float:
    """``edge`` moved to the middle of the gap between the eigenvalues next to it, as far as ``low`` and ``high``."""
    n, ends = above(v, edge), []
    for far in (low, high):
        near = edge
        for _ in range(steps):
            mid = (near + far) / 2
            if above(v, mid) == n:
                near = mid
            else:
                far = mid
        ends.append(near)
    return (ends[0] + ends[1]) / 2


def intervals(v: np.ndarray, wanted: int, size: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), highest first, that hold the ``wanted`` largest eigenvalues of ``v``.

    Eigenvalues under ``FLAT`` of the trace are left out.
    """
    trace = float(np.trace(v))
    if not trace > 0:
        return []
    step = 1e-13 * trace
    low, high = FLAT * trace, 2 * trace
    inside = above(v, low)
    wanted = min(wanted, inside)
    if not wanted:
        return []
    top = high
    while inside > wanted and top - low > 10 * step:
        mid = (low + top) / 2
        n = above(v, mid)
        if n >= wanted:
            low, inside = mid, n
        else:
            top = mid
    todo, edges = [(low, high, inside, 0)], [low, high]
    while todo:
        a, b, below, over = todo.pop()
        if below - over > size and b - a > 100 * step:
            mid = (a + b) / 2
            n = above(v, mid)
            edges.append(mid)
            todo += [(mid, b, n, over), (a, mid, below, n)]
    # Contours cross the axis far from eigenvalues, where the filter is sharp.
    edges.sort()
    counts = [above(v, x) for x in edges]
    kept = [x for i, x in enumerate(edges) if i == len(edges) - 1 or counts[i] != counts[i + 1]]
    around = [-trace, *kept]
    kept = [_between(v, x, around[i], kept[i + 1]) for i, x in enumerate(kept[:-1])]
    # The last contour ends as far above the largest eigenvalue as it begins below it.
    largest, over = kept[-1], high
    for _ in range(24):
        mid = (largest + over) / 2
        largest, over = (mid, over) if above(v, mid) else (largest, mid)
    kept.append(2 * over - kept[-1])
    counts = [above(v, x) for x in kept]
    return [(a, b, m - n) for a, b, m, n in zip(kept, kept[1:], counts, counts[1:])][::-1]


def feast(v: np.ndarray, low: float, high: float, inside: int, seed: int = 42, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenvalues of ``v`` between ``low`` and ``high``, falling, and their unit eigenvectors as columns."""
    d = len(v)
    block = np.random.default_rng(seed).standard_normal((d, min(d, 2 * inside + 4)))
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = (high - low) / 2 * np.exp(0.5j * np.pi * (1 - x))
    shifted = [((low + high) / 2 + t) * np.eye(d) - v for t in turn]
    size, least, idle, best = np.abs(v).max(), np.inf, 0, None
    for _ in range(rounds):
        span = sum(wj / 2 * (t * np.linalg.solve(m, block)).real for wj, t, m in zip(w, turn, shifted))
        u, s, _ = np.linalg.svd(span, full_matrices=False)
        u = u[:, s > 1e-14 * s[0]]
        u = np.linalg.qr(u)[0]
        e, y = np.linalg.eigh(u.T @ v @ u)
        block = u @ y
        found = (e > low) & (e < high)
        left = np.linalg.norm(v @ block[:, found] - block[:, found] * e[found], axis=0).max(initial=0)
        if found.sum() == inside and left < 1e-9 * size:
            if left < least / 2:
                least, idle, best = left, 0, (e[found][::-1], block[:, found][:, ::-1])
            elif left < 1e-11 * size:  # rounding is reached
                idle += 1
            if idle == 3:
                return best
    if best is None:
        raise ArithmeticError(f"inertia counts {inside} eigenvalues between {low} and {high}, but not as many converged")
    return best


def _solver(v: np.ndarray):
    def solve(batches):
        for batch in batches:
            for part in batch.to_pylist():
                e, x = feast(v, part["low"], part["high"], part["inside"])
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(x.T.tolist(), pa.list_(pa.float64()))], names=["e", "x"])

    return solve


def components(spark, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of ``v`` and their eigenvectors as columns, one task for each interval."""
    parts = intervals(v, wanted)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    table = spark.createDataFrame(parts, "low double, high double, inside int").repartition(len(parts))
    found = sorted((r for r in table.mapInArrow(_solver(v), "e double, x array<double>").collect()), key=lambda r: -r["e"])
    if len(found) != sum(p[2] for p in parts):
        raise ArithmeticError("inertia counts and eigenvalues found differ")
    e, x = np.array([r["e"] for r in found[:wanted]]), np.array([r["x"] for r in found[:wanted]]).T
    return e, x * np.sign(x[np.abs(x).argmax(0), np.arange(x.shape[1])])


class Centre:
    """The mean S / n in whole and fraction, so that centred entries keep all their digits."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.floor, self.rest = n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def apart(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.part

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - S)^2, exact; null beyond 38 digits."""
        y = x - self.floor
        if (int(np.abs(y).max(initial=0)) + 1) ** 2 * self.n ** 2 * x.shape[1] < 1 << 63:
            return pa.array(((self.n * y - self.rest) ** 2).sum(1)).cast(pa.decimal128(WIDE, 0))
        exact = ((self.n * y.astype(object) - self.rest.astype(object)) ** 2).sum(1)
        return pa.array([Decimal(int(s)) if s < 10 ** WIDE else None for s in exact], pa.decimal128(WIDE, 0))


def _sums(batches):
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            one = exact_sums(matrix(batch.column(0)))
            n, total = n + batch.num_rows, one if total is None else [a + b for a, b in zip(total, one)]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n] * len(total)), pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(WIDE, 0))],
                                         names=["n", "i", "s"])


def _products(centre: Centre, to: np.ndarray | None):
    """Products of the centred rows of a task (times ``to``), and below them the sums of those rows."""
    def products(batches):
        total = None
        for batch in batches:
            z = centre.apart(matrix(batch.column(0)))
            z = z if to is None else z @ to
            one = np.vstack([z.T @ z, z.sum(0)])
            total = one if total is None else total + one
        if total is not None:
            yield rows_of(total)

    return products


def covariance(x: DataFrame, centre: Centre, to: np.ndarray | None = None) -> np.ndarray:
    """Covariance with divisor n of ``x(x)`` around ``centre``, or of its rows times ``to``."""
    d = len(centre.floor) if to is None else to.shape[1]
    m = summed_matrix(x.mapInArrow(_products(centre, to), "i int, row array<double>"), (d + 1, d)) / centre.n
    return (lambda c: (c + c.T) / 2)(m[:d] - np.outer(m[d], m[d]))


def _projector(centre: Centre, to: np.ndarray, explained: np.ndarray, error: float):
    k = to.shape[1]

    def project(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            n, at = len(x), pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, centre.n)), centre.deviation(x).take(at),
                 pa.array((centre.apart(x) @ to).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return project


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): ``wanted`` rows for each usable row of ``vectors``.

    Vectors that are null, empty, or hold null, non-finite or entries of 2^40 and more take no
    part, and of vectors of several lengths only those of the most common length do.  There
    are fewer components where there are fewer dimensions or the vectors span fewer: an
    eigenvalue of zero has no whitened values, so equal vectors, one vector and an empty table give no
    rows.  Repeated rows count each; ids may be null or repeated; other columns are ignored.
    ``deviation`` is exact, as decimal, and null where it needs more than 38 digits.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v")).filter(usable(F.col("v"), BOUND))
    d = common_length(rows, "v")
    # The integers are narrow numbers, about half as large as the given ones; five passes read them.
    rows = materialize(rows.filter(F.size("v") == d).select("vec_id", F.transform(scaled(F.col("v"), SCALE), lambda c: c + F.lit(SHIFT).cast("long")).alias("x")))
    x = rows.select("x")
    totals = x.mapInArrow(_sums, f"n long, i int, s decimal({WIDE},0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal({WIDE},0), whitened double, explained double, identity_error double"
    if not totals:
        return spark.createDataFrame([], schema)
    centre = Centre(totals[0]["n"], [int(t["s"]) for t in totals])
    v = covariance(x, centre)
    e, c = components(spark, v, wanted)
    if not len(e):
        return spark.createDataFrame([], schema)
    to = c / np.sqrt(e)
    error = float(np.abs(covariance(x, centre, to) - np.eye(len(e))).max())
    return rows.mapInArrow(_projector(centre, to, e / np.trace(v), error), schema)
