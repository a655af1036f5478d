"""Exact deduplication through an extendible-hash index on shared files.

Main path: DataFrame functions only.

1. ``write_index``: one row for each document (id, 64-bit hash, SHA-256 and size of the
   normalised text), written once.
2. ``directory``: buckets are prefixes of the hash.  The directory doubles while a
   bucket holds more than ``capacity`` distinct hashes; a bucket that is not
   overfull keeps its shorter prefix.  Distinct hashes are counted, not rows, so
   thousands of copies of one text make one entry and never split a bucket.
3. ``owners``: buckets in key order are dealt to owner tasks by prefix sums of their rows
   that share a hash.  A bucket above one task's share is cut by a second hash of its
   keys, a key above a tenth of it by its documents' ids.
4. An owner task compares texts byte for byte.  Different texts of one hash form a
   chain: each is an entry of its own.  Parts of a cut key are put together by their texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.llm.common import join_null_safe, lower_ascii, running_total, whole
from kelpgrid.session import materialize

CAPACITY = 8192
PARTS = 10  # a key with more than this part of an owner task's share is hot
MAX_DEPTH = 62


def slot(depth: int) -> Column:
    """The first ``depth`` bits of the hash."""
    return F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")


def write_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, hash, text_sha256, n_bytes) of every row; null text counts as empty."""
    norm = docs.select(F.col(doc_id).alias("doc_id"), lower_ascii(whole(F.col(text))).alias("norm"))
    return materialize(norm.select("doc_id", F.xxhash64("norm").alias("hash"), F.sha2("norm", 256).alias("text_sha256"),
                                   F.octet_length("norm").cast("long").alias("n_bytes")))


def directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[int, DataFrame]:
    """(global depth, (slot, bucket, depth)): every slot of the directory with its bucket.

    ``entries``: distinct ``hash``.  A bucket is named by its depth and its prefix.
    """
    total = entries.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / capacity)))
    while depth < MAX_DEPTH:
        full = entries.groupBy(slot(depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > capacity)
        if full.isEmpty():
            break
        depth += 1
    slots = entries.groupBy(slot(depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    # Siblings that fit one bucket together stay undivided.
    out = slots.select("slot", "n", F.lit(depth).alias("depth"))
    for d in range(depth - 1, max(-1, depth - 4), -1):
        prefix = F.shiftrightunsigned("slot", depth - d)
        joint = F.sum("n").over(Window.partitionBy(prefix))
        out = out.withColumn("depth", F.when(joint <= capacity, F.lit(d)).otherwise(F.col("depth")))
    bucket = F.concat_ws("/", "depth", F.call_function("shiftrightunsigned", F.col("slot"), F.lit(depth) - F.col("depth")))
    return depth, materialize(out.select("slot", bucket.alias("bucket"), "depth"))


def owners(entries: DataFrame, slots: DataFrame, depth: int, share: int) -> DataFrame:
    """(slot, bucket, owner, pieces): owner tasks hold consecutive buckets with about ``share`` rows that share a hash.

    A bucket with more rows has as many ``pieces`` as shares.
    """
    load = entries.filter("n > 1").groupBy(slot(depth).alias("slot")).agg(F.sum("n").alias("load"))
    loaded = slots.join(load, "slot", "left").fillna(0, ["load"])
    buckets = loaded.groupBy("bucket").agg(F.min("slot").alias("first"), F.sum("load").alias("load"))
    upto = running_total(buckets, [], ["first"], "load", "upto")
    return slots.select("slot", "bucket").join(upto.select(
        "bucket", F.floor((F.col("upto") - F.col("load")) / share).alias("owner"),
        F.greatest(F.lit(1), F.ceil(F.col("load") / share)).alias("pieces")), "bucket")


def join_by_hash(rows: DataFrame, entries: DataFrame, keys: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """``rows`` with the one entry of their keys; hot entries are broadcast, so their many rows stay where they are.

    An entry is hot if it has more than a set part of all rows, which bounds their number.
    """
    few = entries.filter(hot)
    near = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(entries.filter(~hot), keys, how)
    return near.unionByName(rest)


def shared_texts(docs: DataFrame, shared: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``shared``, one row for each id and hash in it, with ``norm`` for every row of ``docs`` that has both."""
    norm = docs.select(F.col(doc_id).alias("doc_id"), lower_ascii(whole(F.col(text))).alias("norm")).withColumn("hash", F.xxhash64("norm"))
    # A shuffle at every size: how many documents share a hash has no bound.
    return join_null_safe(norm, shared.hint("merge"), ["doc_id", "hash"])


def chained(texts: DataFrame, tasks: int) -> DataFrame:
    """(hash, text_sha256, keep_id, group_size) of every text, compared in its owner task.

    ``texts``: ``owner``, ``piece``, ``salt`` (above 0 parts of a hot key), ``hot``, ``hash``, ``norm``, ``doc_id``.
    """
    # The grouping keys hold those of the shuffle, so rows stay with their owner.
    own = texts.repartition(tasks, "owner", "piece", "salt").groupBy("owner", "piece", "salt", "hot", "hash", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Only parts of hot keys bring their texts to a second comparison.
    parts = own.select("hash", F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("hot"), F.col("norm")).alias("norm"), "keep_id", "group_size")
    return parts.groupBy("hash", "text_sha256", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).drop("norm")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_bytes, hash), one row for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  The
    largest id of a group stays, a null id only among nulls.  Rows that repeat both id
    and text are alike and all ``kept``; ``kept_documents`` leaves one of them.  An
    empty table gives no rows; other columns are ignored.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = write_index(docs, doc_id, text)
    entries = materialize(index.groupBy("hash").agg(F.count(F.lit(1)).alias("n")))
    depth, slots = directory(entries, capacity)
    rows = entries.agg(F.sum("n")).first()[0] or 0
    share = math.ceil(max(1, rows) / tasks)
    limit = share / PARTS  # fewer than PARTS * tasks keys have more rows
    # Only documents whose hash occurs again bring their texts.
    again = entries.filter("n > 1").withColumn("slot", slot(depth)).join(owners(entries, slots, depth, share), "slot")
    again = materialize(again.select("hash", "n", "owner", F.pmod(F.xxhash64("hash"), "pieces").alias("piece")))
    hot = F.col("n") > limit
    cuts = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / limit))
    shared = join_by_hash(index.select("doc_id", "hash"), again, ["hash"], hot).select(
        "doc_id", "hash", "owner", "piece", hot.alias("hot"), F.when(hot, cuts).otherwise(F.lit(0)).alias("salt")).distinct()
    chains = materialize(chained(shared_texts(docs, materialize(shared), doc_id, text), tasks))
    out = join_by_hash(index, chains, ["hash", "text_sha256"], F.col("group_size") > limit, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "n_bytes", "hash")


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; one row of those that repeat both id and text."""
    stays = deduplicate(docs, doc_id, text, capacity).filter("kept").groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("__n"))
    stays = stays.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "__n")
    keyed = docs.withColumn("__h", F.xxhash64(lower_ascii(whole(F.col(text)))))
    found = keyed.join(stays, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")))
    again = found.filter("__n > 1").dropDuplicates(["__id", "__hash"])
    return found.filter("__n = 1").unionByName(again).select(*docs.columns)
