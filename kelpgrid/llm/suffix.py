"""Removing repeated passages with a sparse suffix array.

A byte goes if a string of 400 bytes over it starts anywhere else.  Sorting every
suffix is not needed to find these strings:

* Each string of 400 bytes has an anchor, the place of the smallest hash of 32 bytes in it.
  Equal strings have their anchors at the same distance, so strings are named by
  anchor and distance, and strings in a row share one.  A block is a run of up to 128 such
  neighbours, cut at multiples of 128 of the distance.
* A block stands for two suffixes: the one that all its strings have in common (its
  core) and the one that they cover together.  Tokens are hashes of those bytes.  If the
  core occurs nowhere else none of the strings does; if the whole does, all do.
* Blocks are range-partitioned by their tokens at sampled splitters, each bucket is sorted
  by multikey quicksort, and neighbours are compared, across the bounds of buckets too.  A group of
  equal suffixes of any size is a run in that order, cut over as many buckets as it fills.
* What is still open, the ends of repeated passages, is cut finer, to blocks of 8 and then to
  single strings, and sorted again.

Tokens only name candidates.  Before anything is removed, blocks of equal tokens are told apart
by SHA-256 of their bytes; where a block turns out to be alone, each string that
could equal one of its own is compared in the same way.  So a collision of tokens removes no byte.  It can
hide a repeat if two blocks of one core differ but share the token of the whole, which joins a sum modulo 2^64 with
one modulo 2^31 - 1 whose base is drawn for each run, so that no text can be made to collide beforehand.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.llm.common import join_null_safe, whole
from kelpgrid.session import discard, materialize

LENGTH = 400
GRAM = 32
COARSE, FINE = 128, 8
BASE = 0x9E3779B97F4A7C15 | 1
BLOCKS = "first int, n int, dist int, core long, whole long"
FINE_BLOCKS = "array<struct<first:int,n:int,core:long,whole:long,each:array<long>>>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Where to anchor: hashes of short substrings from prefix sums modulo 2^64, the same for equal bytes."""

    values = _mix(np.arange(1, 257, dtype=np.uint64))
    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    @classmethod
    def prepare(cls, n: int) -> None:
        if len(cls.powers) <= n:
            size = max(1 << 16, 2 * n)
            base = np.full(size, BASE, np.uint64)
            base[0] = 1
            cls.powers = np.multiply.accumulate(base)
            base[1:] = np.uint64(pow(BASE, -1, 1 << 64))
            cls.inverse = np.multiply.accumulate(base)

    def __init__(self, a: np.ndarray):
        self.n = len(a)
        self.prepare(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.values[a] * self.powers[:self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]

    def anchors(self, length: int, gram: int) -> np.ndarray:
        """Place of the smallest hash of ``gram`` bytes in each string of ``length`` bytes; the first one of equals."""
        m = self.n - gram + 1
        h = _mix((self.sums[gram:] - self.sums[:m]) * self.inverse[:m])
        bits = np.uint64(max(1, int(m).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        key = (h & ~low) | np.arange(m, dtype=np.uint64)
        w = length - gram + 1
        rows = -(-m // w)
        grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
        grid[:m] = key
        grid = grid.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
        count = self.n - length + 1
        return (np.minimum(behind[:count], ahead[w - 1:w - 1 + count]) & low).astype(np.int64)


PRIME = (1 << 31) - 1
_P = np.uint64(PRIME)


def _reduce(x: np.ndarray) -> np.ndarray:
    """Modulo 2^31 - 1, of numbers below 2^62; the prime itself may stand for 0."""
    x = (x & _P) + (x >> np.uint64(31))
    return (x & _P) + (x >> np.uint64(31))


class Base:
    """Powers of a base modulo 2^31 - 1 and of its inverse, as many as texts need."""

    kept: dict[int, Base] = {}

    def __init__(self, base: int):
        self.steps = (base, pow(base, -1, PRIME))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    @classmethod
    def of(cls, base: int) -> Base:
        if base not in cls.kept:
            if len(cls.kept) > 8:
                cls.kept.clear()
            cls.kept[base] = cls(base)
        return cls.kept[base]

    def up_to(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) <= n:
            size = len(self.tables[0])
            self.tables = [np.concatenate([t, _reduce(t * np.uint64(pow(s, size, PRIME)))]) for t, s in zip(self.tables, self.steps)]
        return self.tables


class Check:
    """Hashes of substrings from prefix sums of byte values times powers of ``base``, modulo 2^31 - 1."""

    values = Grams.values >> np.uint64(34)

    def __init__(self, a: np.ndarray, base: int):
        powers, self.inverse = Base.of(base).up_to(len(a) + 1)
        terms = self.values[a]
        terms *= powers[:len(a)]
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((terms & _P) + (terms >> np.uint64(31)), out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = _reduce(_reduce(self.sums[stop] - self.sums[start]) * self.inverse[start])
        return np.where(h == _P, np.uint64(0), h)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


class Text:
    """A text with the sums that name its blocks."""

    def __init__(self, body: bytes, base: int):
        self.bytes = np.frombuffer(body, np.uint8)
        self.grams, self.check = Grams(self.bytes), Check(self.bytes, base)

    def whole(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix(self.grams.of(start, stop) + _mix(self.check.of(start, stop)))

    def blocks(self, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, size: int):
        """Tokens of blocks of strings ``first`` to ``last``: of the core, and of all bytes covered."""
        q = (anchor - first) // size
        start = anchor - q * size
        core = _mix(self.grams.of(start, start - size + 1 + LENGTH) + q.astype(np.uint64))
        span = ((anchor - first).astype(np.uint64) << np.uint64(32)) | (anchor - last).astype(np.uint64)
        return _signed(core), _signed(_mix(self.whole(first, last + LENGTH) ^ _mix(span)))


def coarse_blocks(body: bytes, base: int):
    """(first, n, dist, core, whole) of the coarse blocks of a text."""
    text = Text(body, base)
    at = text.grams.anchors(LENGTH, GRAM)
    p = np.arange(len(at))
    cell = (at - p) // COARSE
    cut = np.flatnonzero((at[1:] != at[:-1]) | (cell[1:] != cell[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    core, both = text.blocks(first, last, at[first], COARSE)
    return first, last - first + 1, at[first] - first, core, both


def fine_blocks(text: Text, first: int, n: int, dist: int):
    """Blocks of up to ``FINE`` strings of one coarse block, each with the hashes of its strings."""
    p = np.arange(first, first + n)
    cell = (first + dist - p) // FINE
    cut = np.flatnonzero(cell[1:] != cell[:-1]) + 1
    lo, hi = p[np.concatenate([[0], cut])], p[np.concatenate([cut, [n]]) - 1]
    core, both = text.blocks(lo, hi, np.full(len(lo), first + dist), FINE)
    each = _signed(text.whole(p, p + LENGTH))
    return [(int(a), int(b - a + 1), int(c), int(u), each[a - first:b - first + 1].tolist()) for a, b, c, u in zip(lo, hi, core, both)]


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _find(base: int):
    def find(batches):
        for batch in batches:
            ids, cols = [], [[], [], [], [], []]
            for i, t in enumerate(batch.column(2)):
                body = _bytes(t.as_py())
                if len(body) < LENGTH:
                    continue
                found = coarse_blocks(body, base)
                ids.append(np.full(len(found[0]), i))
                for c, v in zip(cols, found):
                    c.append(v)
            if not ids:
                continue
            at = pa.array(np.concatenate(ids))
            data = [np.concatenate(c) for c in cols]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(d.astype(np.int32)) for d in data[:3]], *[pa.array(d) for d in data[3:]]],
                names=["doc_id", "key", "first", "n", "dist", "core", "whole"])

    return find


def multikey_quicksort(tokens: list[np.ndarray], small: int = 2048) -> np.ndarray:
    """Order of rows by their tokens: three-way partitions on one token; only equal ones go on to the next."""
    order = np.arange(len(tokens[0]))
    stack = [(0, len(order), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == len(tokens):
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort([t[part] for t in tokens[:depth - 1 if depth else None:-1]])]
            continue
        v = tokens[depth][part]
        pivot = np.sort(v[[0, len(v) // 2, -1]])[1]
        less, same = v < pivot, v == pivot
        a, b = lo + int(less.sum()), lo + int(less.sum()) + int(same.sum())
        order[lo:hi] = np.concatenate([part[less], part[same], part[~(less | same)]])
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _sort_bucket(batches):
    """Sort a bucket and mark rows whose core, or core and whole, equal a neighbour's; drop those that cannot repeat."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    core, both = (table.column(c).to_numpy() for c in ("core", "whole"))
    order = multikey_quicksort([core, both])
    c, u = core[order], both[order]
    near_c = np.zeros(len(c) + 1, bool)
    near_c[1:-1] = c[1:] == c[:-1]
    near_u = np.zeros(len(c) + 1, bool)
    near_u[1:-1] = near_c[1:-1] & (u[1:] == u[:-1])
    part, all_ = near_c[1:] | near_c[:-1], near_u[1:] | near_u[:-1]
    keep = part | (c == c[0]) | (c == c[-1])
    out = table.take(pa.array(order[keep])).append_column("part", pa.array(part[keep])).append_column("all", pa.array(all_[keep]))
    yield from out.append_column("bucket", pa.array(np.full(int(keep.sum()), TaskContext.get().partitionId(), np.int32))).to_batches(10_000)


def repeats(blocks: DataFrame) -> DataFrame:
    """Rows of ``blocks(..., core, whole)`` whose core occurs again, with ``all``: the whole does."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = [c for c in ("doc_id", "key", "first") if c in blocks.columns]
    spread = blocks.repartitionByRange(n, "core", "whole", *ties)
    schema = blocks.schema
    for name, kind in (("part", "boolean"), ("all", "boolean"), ("bucket", "integer")):
        schema = type(schema)(list(schema.fields)).add(name, kind)
    rows = materialize(spread.mapInArrow(_sort_bucket, schema))
    ends = rows.groupBy("bucket").agg(F.min(F.struct("core", "whole")).alias("lo"), F.max(F.struct("core", "whole")).alias("hi"))
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    ends = ends.select("bucket", F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))
    # one row for each bucket
    rows = rows.join(F.broadcast(ends), "bucket")

    def meets(side):
        same = F.col(f"{side}.core") == F.col("core")
        return F.coalesce(same, F.lit(False)), F.coalesce(same & (F.col(f"{side}.whole") == F.col("whole")), F.lit(False))

    (bc, bw), (ac, aw) = meets("before"), meets("after")
    rows = rows.withColumns({"part": F.col("part") | bc | ac, "all": F.col("all") | bw | aw})
    return rows.filter("part").drop("part", "bucket", "before", "after")


def with_need(rows: DataFrame) -> DataFrame:
    """Add ``need``: the block has to be cut finer, as it is open or as one of those equal to it may match an open one."""
    opened = rows.filter("not all").select("core").distinct()
    one = rows.filter("all").groupBy("core", "whole").agg(F.min(F.struct("doc_id", "key", "first")).alias("one"))
    one = one.join(opened, "core", "left_semi").select("one.*", F.lit(True).alias("chosen"))
    return join_null_safe(rows, one, ["doc_id", "key", "first"], "left").withColumn("need", ~F.col("all") | F.coalesce("chosen", F.lit(False))).drop("chosen")


def _open_texts(base: int):
    """Fine blocks of what is open in texts with a repeated core; the text goes on as it is."""
    kinds = dict(doc_id=pa.int64(), key=pa.int64(), text=pa.string(), done=pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])),
                 open=pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("core", pa.int64()), ("whole", pa.int64()), ("each", pa.list_(pa.int64()))])))

    def run(batches):
        for batch in batches:
            done, opened = [], []
            for text, found in zip(batch.column(2), batch.column(3)):
                found = found.as_py() or ()
                done.append([{"first": x["first"], "n": x["n"]} for x in found if x["all"]] if found else None)
                t = Text(_bytes(text.as_py()), base) if any(x["need"] for x in found) else None
                opened.append([dict(zip(("first", "n", "core", "whole", "each"), r)) for x in found if x["need"] for r in fine_blocks(t, x["first"], x["n"], x["dist"])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(done, kinds["done"]), pa.array(opened, kinds["open"])], names=list(kinds))

    return run


def spans(found, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs covered by strings ``first .. first + n - 1`` of ``length`` bytes."""
    out: list[list[int]] = []
    for first, n in sorted(found):
        stop = first + n - 1 + length
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return [(a, b) for a, b in out]


def candidates(done, late, inner: list | None = None) -> list[tuple[int, int]]:
    """(first, n) of the blocks that were found, in order; those inside others go to ``inner``."""
    out, end = [], -1
    for first, n in sorted({(x["first"], x["n"]) for x in [*(done or ()), *(late or ())]}, key=lambda x: (x[0], -x[1])):
        if first + n > end:
            out.append((first, n))
            end = first + n
        elif inner is not None:
            inner.append((first, n))
    return out


def _digests(batches):
    """Place and SHA-256 of the bytes of each block that was found; ``inner``: inside another one."""
    for batch in batches:
        at, cols = [], [[], [], [], []]
        for i, (text, done, late) in enumerate(zip(*(batch.column(c) for c in (2, 3, 4)))):
            body, inner = _bytes(text.as_py()), []
            outer = candidates(done.as_py(), late.as_py(), inner)
            for places, inside in ((outer, False), (inner, True)):
                for first, n in places:
                    at.append(i)
                    for c, v in zip(cols, (first, n, inside, hashlib.sha256(body[first:first + n - 1 + LENGTH]).digest())):
                        c.append(v)
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, pa.int32()) for c in cols[:2]], pa.array(cols[2], pa.bool_()),
                                          pa.array(cols[3], pa.binary())], names=["doc_id", "key", "first", "n", "inner", "sha"])


def _strings(batches):
    """SHA-256 of every string of the listed blocks of each text."""
    for batch in batches:
        for doc, key, text, listed in zip(*(batch.column(c).to_pylist() for c in range(4))):
            body = _bytes(text)
            places = sorted({p for x in listed for p in range(x["first"], x["first"] + x["n"])})
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc] * len(places), pa.int64()), pa.array([key] * len(places), pa.int64()), pa.array(places, pa.int32()), pa.array([1] * len(places), pa.int32()),
                 pa.array([hashlib.sha256(body[p:p + LENGTH]).digest() for p in places], pa.binary())], names=["doc_id", "key", "first", "n", "sha"])


PLACE = ["doc_id", "key", "first", "n"]


def compared(touched: DataFrame, coarse: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """What the bytes say about the candidates of ``touched``: (blocks to leave out, strings to add); None if each has an equal.

    ``coarse(doc_id, key, first, n, core)``: the coarse blocks whose core occurs again.
    """
    blocks = touched.mapInArrow(_digests, "doc_id long, key long, first int, n int, inner boolean, sha binary")
    alone = blocks.groupBy("sha").agg(F.count(F.lit(1)).alias("again"), F.min(F.struct(*PLACE, "inner")).alias("b"))
    alone = materialize(alone.filter("again = 1 and not b.inner").select("b.*").drop("inner"))
    if alone.isEmpty():
        return None
    hit = join_null_safe(coarse.withColumnsRenamed({"first": "from", "n": "many"}), alone, ["doc_id", "key"]).filter("first >= `from` and first < `from` + many").select("core").distinct()
    listed = coarse.join(hit, "core", "left_semi").groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n")).alias("listed"))
    rows = join_null_safe(touched.select("doc_id", "key", "text"), listed, ["doc_id", "key"]).select("doc_id", "key", "text", "listed")
    strings = materialize(rows.mapInArrow(_strings, "doc_id long, key long, first int, n int, sha binary"))
    again = strings.groupBy("sha").agg(F.count(F.lit(1)).alias("again")).filter("again > 1")
    return alone, materialize(strings.join(again, "sha", "left_semi").select(*PLACE).distinct())


RESULT = "doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept_text string"


def _finish(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        out = [[] for _ in range(7)]
        for i in range(batch.num_rows):
            text, done, late, wrong, more = (batch.column(c)[i].as_py() for c in range(2, 7))
            body, wrong = _bytes(text), {(x["first"], x["n"]) for x in wrong or ()}
            found = [x for x in candidates(done, late) if x not in wrong] + [(x["first"], x["n"]) for x in more or ()]
            runs, at, kept = spans(found), 0, []
            for a, b in runs:
                kept.append(body[at:a])
                at = b
            kept = b"".join([*kept, body[at:]])
            row = (len(body), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in runs],
                   text if not runs else kept.decode("utf-8", "replace"))
            for c, v in zip(out, row):
                c.append(v)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string()), pa.array(out[4], kind), pa.array(out[5], pa.string())],
                                         names=["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: int | None = None) -> DataFrame:
    """(doc_id, key, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text), one row for each row of ``docs``.

    ``spans``: the maximal removed runs, as byte offsets; ``kept_text``: the other bytes, with U+FFFD where a
    cut falls inside a character.  Null text counts as empty; texts under 400
    bytes keep everything.  Repeated rows are separate documents, so long ones remove each
    other.  Null ids are allowed.  An empty table gives no rows; other columns are ignored.
    The ``base`` of the second sum is drawn anew for each run if not given.
    """
    base = base or secrets.randbelow(PRIME - 3) + 2
    body = whole(F.col(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text"))
    # Written before they are dealt out by ranges, whose sampling would name them twice.
    named = materialize(rows.mapInArrow(_find(base), "doc_id long, key long, " + BLOCKS))
    coarse = materialize(with_need(repeats(named)))
    discard(named)
    found = coarse.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n", "dist", "all", "need")).alias("found"))
    opened = join_null_safe(rows, found, ["doc_id", "key"], "left").select("doc_id", "key", "text", "found")
    opened = materialize(opened.mapInArrow(_open_texts(base), f"doc_id long, key long, text string, done array<struct<first:int,n:int>>, open {FINE_BLOCKS}"))
    fine = repeats(opened.select("doc_id", "key", F.explode("open").alias("b")).select("doc_id", "key", "b.*"))
    fine = materialize(with_need(fine))
    single = fine.filter("need").select("doc_id", "key", "core", "first", F.posexplode("each").alias("i", "whole"))
    single = repeats(single.select("doc_id", "key", (F.col("first") + F.col("i")).alias("first"), F.lit(1).alias("n"), "core", "whole")).filter("all")
    late = fine.filter("all").select("doc_id", "key", "first", "n").union(single.select("doc_id", "key", "first", "n"))
    late = materialize(late.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n")).alias("late")))
    touched = join_null_safe(opened.filter("done is not null").select("doc_id", "key", "text", "done"), late, ["doc_id", "key"], "left")
    touched = touched.select("doc_id", "key", "text", "done", "late")
    change = compared(touched, coarse.select(*PLACE, "core"))
    listed = "array<struct<first:int,n:int>>"
    if change is None:
        touched = touched.withColumns({c: F.lit(None).cast(listed) for c in ("wrong", "more")})
    else:
        for name, places in zip(("wrong", "more"), change):
            places = places.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n")).alias(name))
            touched = join_null_safe(touched, places, ["doc_id", "key"], "left")
    touched = touched.select("doc_id", "key", "text", "done", "late", "wrong", "more")
    none = opened.filter("done is null").select("doc_id", "key", "text", *[F.lit(None).cast(listed).alias(c) for c in ("done", "late", "wrong", "more")])
    return touched.mapInArrow(_finish, RESULT).union(none.select(
        "doc_id", "key", F.octet_length("text").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2("text", 256),
        F.array().cast("array<struct<start:bigint,stop:bigint>>"), "text"))
