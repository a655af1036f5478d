"""SimHash fingerprints and their neighbours by multi-index hashing.

A fingerprint is cut into two segments of 32 bits.  If two fingerprints differ in at
most two bits, either their upper segments differ in at most one bit or their lower
segments are equal.  So each distinct fingerprint enumerates the Hamming ball of
radius 1 around its upper segment (from one side: a bit is only switched on) and the
ball of radius 0 around its lower one, fetches the fingerprints that the segment
tables hold there, and keeps those at full distance 2 or less.

A table entry with more than ``dense`` distinct fingerprints is not listed against
its probes, as that would cost the product of both.  There, probe and entry both
enumerate the ball of radius 1 around the whole fingerprint; two fingerprints
differ in at most two bits exactly if they share such a key, a key holds 65
fingerprints at most, and one link to the smallest of them joins them all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kelpgrid.operators.components import connected_components
from kelpgrid.session import materialize

SHINGLE = 3
SEED = 42
DISTANCE = 2
DENSE = 64
STEP = 1 << 16
LOW = 0xFFFFFFFF


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of a whole text; 0 without words."""
    if not text:
        return 0
    ws = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and only ASCII white space
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    last = min(SHINGLE, len(ws)) - 1
    begin, stop = starts[:len(ws) - last].tolist(), (ends[last:] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(begin), STEP):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(begin[i:i + STEP], stop[i:i + STEP])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(begin), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1)
        found = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), found, *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, fp) of every row, with ``more`` columns, written once."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *more)
    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType()), *rows.schema.fields[2:]])
    return materialize(rows.mapInArrow(_fingerprints, schema))


def _flips(value: Column, bits: int) -> Column:
    return F.array(*[value.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(bits)])


def meetings(fps: DataFrame, dense: int = DENSE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct ``fp`` -> (pairs (src, dst) verified in the tables, fingerprints ``fp`` that meet at keys, (fp, least, others) of each of their keys).

    ``least``: the smallest fingerprint at the key; ``others``: how many are there besides ``fp``, none left out.
    """
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW))
    # table 0: upper segments, table 1: lower segments
    table = fps.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("t"), upper.alias("seg")), F.struct(F.lit(1).alias("t"), lower.alias("seg")))).alias("s")).select("fp", "s.*")
    table = materialize(table)
    sizes = table.groupBy("t", "seg").agg(F.count(F.lit(1)).alias("n"))
    heavy = materialize(sizes.filter(F.col("n") > dense).select("t", "seg"))
    ball = F.filter(F.concat(F.array(upper), _flips(upper, 32)), lambda s: s >= upper)
    probes = fps.select("fp", F.explode(F.concat(
        F.transform(ball, lambda s: F.struct(F.lit(0).alias("t"), s.alias("seg"))),
        F.array(F.struct(F.lit(1).alias("t"), lower.alias("seg"))))).alias("s")).select("fp", "s.*")
    entries = table.withColumnRenamed("fp", "other")
    found = probes.join(entries.join(heavy, ["t", "seg"], "left_anti"), ["t", "seg"])
    found = found.filter((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE))
    # Dense entries: everyone who is in one or asks for one meets at single keys instead.
    asked = probes.join(heavy, ["t", "seg"], "left_semi").select("fp").union(table.join(heavy, ["t", "seg"], "left_semi").select("fp")).distinct()
    asked = materialize(asked)
    near = asked.select("fp", F.explode(F.concat(F.array("fp"), _flips(F.col("fp"), 64))).alias("key"))
    lowest = near.groupBy("key").agg(F.min("fp").alias("least"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    keys = materialize(lowest.select(F.explode("all").alias("fp"), "least", (F.size("all") - 1).alias("others")))
    pairs = materialize(found.select(F.greatest("fp", "other").alias("src"), F.least("fp", "other").alias("dst")).distinct())
    return pairs, asked, keys


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Distinct ``fp`` -> links (src, dst) that connect whatever is at distance 2 or less.

    Pairs found in the tables are all verified; inside dense entries a chain of links
    through the smallest fingerprint of each key stands for the pairs.
    """
    return _links(*meetings(fps, dense))


def _links(pairs: DataFrame, asked: DataFrame, keys: DataFrame) -> DataFrame:
    return pairs.union(keys.filter("fp <> least").select(F.col("fp").alias("src"), F.col("least").alias("dst"))).distinct()


def link_counts(pairs: DataFrame, asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(fp, n_links): the other fingerprints at distance 2 or less, of each that has one.

    Two fingerprints at distance 1 or 2 share exactly two keys, so those that meet at
    keys count each other twice; pairs of the tables count unless both ends are among them.
    """
    for end in ("src", "dst"):
        pairs = pairs.join(asked.select(F.col("fp").alias(end), F.lit(True).alias(f"{end}_asked")), end, "left")
    once = pairs.filter("src_asked is null or dst_asked is null").select(F.explode(F.array("src", "dst")).alias("fp"), F.lit(2).alias("n"))
    return once.union(keys.select("fp", "others")).groupBy("fp").agg((F.sum("n") / 2).cast("long").alias("n_links"))


def components(rows: DataFrame, dense: int = DENSE) -> tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame]:
    """``rows(doc_id, fp)`` -> (``meetings``, (fp, class_id, root)), one row for each distinct fingerprint."""
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("class_id")))
    met = meetings(classes.select("fp"), dense)
    edges = materialize(_links(*met))
    comp = connected_components(edges, classes.select(F.col("fp").alias("node")))
    return met, classes.join(comp, F.col("fp") == F.col("node")).select("fp", "class_id", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """(doc_id, fingerprint, component_id, class_id, n_links), one row for each row of ``docs``.

    ``n_links``: other fingerprints of the table at distance 2 or less, each counted once.
    ``class_id``: smallest id with the same fingerprint; ``component_id``: smallest id reachable
    over links at distance 2 or less.  Null, empty and wordless texts have fingerprint 0
    and are linked like any other.  A null id is reported but never names a
    component unless all ids of it are null.  Repeated rows fall into one class.  An empty table gives no rows.
    """
    rows = fingerprints(docs, doc_id, text)
    met, named = components(rows, dense)
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = materialize(named.join(least, "root").join(link_counts(*met), "fp", "left").select("fp", "class_id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class_id", "n_links")


def text_keys(text: Column) -> list[Column]:
    """Two independent 64-bit hashes; together they stand for the text."""
    return [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(SEED), text).alias("__h2")]


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """The rows of ``docs``, with their columns, that stay: one of each component, with the smallest id.

    A null id only stays where all ids of the component are null.  Ids need not be unique:
    a component is known by its root, and the row that stays by its id and its text.
    If rows repeat both, one of them stays.
    """
    rows = fingerprints(docs, doc_id, text, text_keys(F.col(text)))
    _, named = components(rows, dense)
    alike = rows.groupBy("fp", "doc_id", "__h1", "__h2").agg(F.count(F.lit(1)).alias("__n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "__h1", "__h2", "__n")).alias("first")
    least = alike.groupBy("fp").agg(first).join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    stays = materialize(least.select(F.col("first.doc_id").alias("__id"), F.col("first.__h1").alias("__s1"), F.col("first.__h2").alias("__s2"), F.col("first.__n").alias("__n")))
    keyed = docs.select("*", *text_keys(F.col(text)))
    found = keyed.join(stays, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__h1") == F.col("__s1")) & (F.col("__h2") == F.col("__s2")))
    return found.filter("__n = 1").unionByName(found.filter("__n > 1").dropDuplicates(["__id", "__s1", "__s2"])).select(*docs.columns)
