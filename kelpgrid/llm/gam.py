"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over bins, and so have a few pairs of
features.  Training cycles over the features; in every turn a shallow tree over the
bins is fitted to the gradient and a small share of it is added to the feature's table.
Pairs are chosen by how much of the remaining gradient a cut in both features explains,
and trained in the same way.  A score adds one table entry for each feature and pair.

Only training sees the driver: a sample of at most ``Settings.sample`` labelled rows,
reduced to features.  Features and scores are computed inside tasks, over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.session import materialize

FEATURES = ("words", "word_bytes", "symbols", "bars", "bangs", "capitals", "digits", "stops", "lines", "repeated_lines",
            "distinct_words", "foreign_bytes", "longest_line", "marks", "longest_word", "common_word")
CUT = 0.7


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000
    bins: int = 32
    rounds: int = 120
    pairs: int = 6
    pair_bins: int = 8
    rate: float = 0.15
    leaves: int = 3
    least: float = 2.0  # smallest sum of second derivatives in a leaf
    seed: int = 42


def features(text: str | None) -> list[float]:
    """Features of a whole text; all 0 without words (null, empty or white space only)."""
    b = (text or "").encode("utf-8", "surrogatepass")
    ws = b.split()
    if not ws:
        return [0.0] * len(FEATURES)
    n, w = len(b), len(ws)
    lines = [x for x in b.split(b"\n") if x.strip()]
    size = n - len(b.translate(None, b" \t\n\x0b\f\r"))
    ascii_part = len(b.translate(None, bytes(range(128, 256))))
    seen: dict[bytes, int] = {}
    for x in ws:
        seen[x] = seen.get(x, 0) + 1
    return [
        float(np.log1p(w)), (n - size) / w, sum(map(b.count, (b"#", b"*", b"$", b"%", b"&"))) / w, b.count(b"|") / w, b.count(b"!") / w,
        (n - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / n, (n - len(b.translate(None, b"0123456789"))) / n,
        (b.count(b".") + b.count(b",")) / w, len(lines) / w, 1 - len(set(lines)) / len(lines), len(seen) / w, 1 - ascii_part / n,
        max(map(len, lines)) / n, (n - len(b.translate(None, b"@/:=<>{}[]();_\\"))) / w, float(max(map(len, seen))), max(seen.values()) / w]


def _tree(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    """Values over bins of a shallow regression tree on gradient and second-derivative histograms."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    cuts = [0, len(g)]

    def gain(lo, hi):
        at = np.arange(lo + 1, hi)
        if not len(at):
            return -1.0, lo
        gl, hl, gr, hr = cg[at] - cg[lo], ch[at] - ch[lo], cg[hi] - cg[at], ch[hi] - ch[at]
        value = gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + 1)
        value[(hl < s.least) | (hr < s.least)] = -1
        best = int(np.argmax(value))
        return float(value[best]), int(at[best])

    for _ in range(s.leaves - 1):
        best = max(gain(a, b) for a, b in zip(cuts, cuts[1:]))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut in both features of a pair: its gain, and the four values over the cells."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, values = 0.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            a, c = np.empty(4), np.empty(4)
            for x, t in ((a, cg), (c, ch)):
                x[0], x[1] = t[i, j], t[i, -1] - t[i, j]
                x[2], x[3] = t[-1, j] - t[i, j], t[-1, -1] - t[i, -1] - t[-1, j] + t[i, j]
            gain = float((a ** 2 / (c + 1)).sum())
            if gain > best:
                v, best = a / (c + 1), gain
                values = np.empty_like(g)
                values[:i + 1, :j + 1], values[:i + 1, j + 1:], values[i + 1:, :j + 1], values[i + 1:, j + 1:] = v
    return best, values


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features: one addition for each table."""
        total = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, f], "right")]
        coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.pair_edges)]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def train(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    """Fit on features and labels 0/1.  Without rows, or with one label only, the score is a constant."""
    n, k = len(y), x.shape[1]
    rate = (y.sum() + 0.5) / (n + 1)
    empty = [np.empty(0)] * k
    if n == 0 or y.min() == y.max():
        return Model(float(np.log(rate / (1 - rate))), empty, [np.zeros(1)] * k, empty, [], [])
    edges, coarse_edges = [_edges(x[:, f], s.bins) for f in range(k)], [_edges(x[:, f], s.pair_bins) for f in range(k)]
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse_edges)]
    m = Model(float(np.log(rate / (1 - rate))), edges, [np.zeros(len(e) + 1) for e in edges], coarse_edges, [], [])
    total = np.full(n, m.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(s.rounds):
        for f in range(k):
            g, h = slopes()
            step = s.rate * _tree(np.bincount(at[f], g, len(edges[f]) + 1), np.bincount(at[f], h, len(edges[f]) + 1), s)
            m.tables[f] += step
            total += step[at[f]]

    def cells(i, j, v):
        shape = (len(coarse_edges[i]) + 1, len(coarse_edges[j]) + 1)
        return np.bincount(coarse[i] * shape[1] + coarse[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((-_quadrants(cells(i, j, g), cells(i, j, h))[0], (i, j)) for i, j in combinations(range(k), 2)))
    m.pairs = [p for _, p in ranked[:s.pairs]]
    m.pair_tables = [np.zeros((len(coarse_edges[i]) + 1, len(coarse_edges[j]) + 1)) for i, j in m.pairs]
    for _ in range(s.rounds // 4):
        for t, (i, j) in zip(m.pair_tables, m.pairs):
            g, h = slopes()
            step = s.rate * _quadrants(cells(i, j, g), cells(i, j, h))[1]
            t += step
            total += step[coarse[i], coarse[j]]
    return m


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _features(batches):
    for batch in batches:
        found = pa.array([features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([found, *batch.columns[1:]], names=["x", *batch.schema.names[1:]])


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> Model:
    """Model of ``labels(doc_id, quality)``, from at most ``s.sample`` rows in the order of a hash of the id.

    Null ids and labels teach nothing; of several labels of one id the largest counts, and of
    several texts of one id the one whose hash is smallest.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("y")).filter("__id is not null and y is not null")
    known = known.filter(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("y").cast("double").alias("y"))
    known = materialize(known.orderBy(F.xxhash64("__id", F.lit(s.seed)), "__id").limit(s.sample))
    body = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("text"))
    # s.sample rows of two numbers: a bound on the broadcast.
    rows = body.join(F.broadcast(known), F.col("__doc") == F.col("__id")).select("text", "y", F.col("__id").cast("long"), F.xxhash64("text").alias("h"))
    rows = rows.mapInArrow(_features, "x array<double>, y double, __id long, h long")
    # One row for each id before anything leaves the tasks.
    got = rows.groupBy("__id", "y").agg(F.min_by("x", "h").alias("x")).select("x", "y").toPandas()
    got = got.assign(k=[tuple(v) for v in got["x"]]).sort_values(["k", "y"]) if len(got) else got
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return train(x, got["y"].to_numpy(float), s)


def with_score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1, of every whole text; a column of that name is replaced."""
    keep = [c for c in docs.columns if c != "score"]
    at = keep.index(text)

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, "score"])

    schema = docs.select(*keep).schema.add("score", "double")
    return docs.select(*keep).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    The score sees the text alone; null and empty texts have the score of a text without
    words.  Rows with null ids are scored and not held out.  An empty table gives no
    rows, and without labels every score is 0.5.
    """
    model = fit(docs, labels, s, doc_id, text)
    rows = with_score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
