"""Sharding linked documents by balanced label propagation.

Documents start evenly spread.  In each round the linked documents of a group are counted, over a
join of groups and places, by the shard they are in, and the group asks to move to the shard
that most of them are in.  Shards admit as many documents as their quota has room for, the groups with the
most votes first, and an admitted group moves there whole.  Groups that found no room give up the places that
others now hold: they are dealt anew over the room that is left, side by side, and ask again.  Each
round with an admission joins a group for good, and rounds end when none is admitted.  What is left,
and documents without links, fill the rooms.

Every shard keeps its number of rows, and the law of sizes is ``rows``: counts at most one
apart.  A group larger than a shard moves in parts of a shard's size, so no group is ever too large to move.
Groups are counted before they are shuffled; a round moves one row for each group and shard.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgrid.llm.common import BASE, PART, ROW, ranked, running_index, running_total, whole, with_bases
from kelpgrid.session import discard, materialize

SHARDS = 40
SEED = 42


def spread(docs: DataFrame, order: list, shards: int) -> DataFrame:
    """``docs`` with ``node``, its place in ``order`` from 0, and ``shard``: neighbours in the order go to different shards."""
    rows = with_bases(running_index(docs, order), F.count(F.lit(1)))
    rows = rows.withColumn("node", F.col(ROW) + F.col(BASE)).drop(PART, ROW, BASE)
    return materialize(rows.withColumn("shard", (F.col("node") % shards).cast("int")))


def linked(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(node, shard, label) of the rows that share ``keys``; a label names at most ``most`` of them."""
    groups = rows.groupBy(*keys).agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = ranked(rows.join(groups, keys).select("node", "shard", "first"), ["first"], ["node"], "rank")
    return members.select("node", "shard", F.struct("first", F.floor(F.col("rank") / most).alias("part")).alias("label"))


def dealt(rows: DataFrame, order: list, rooms: dict[int, int], seed: int) -> DataFrame:
    """(.., shard) of ``rows`` dealt along ``order`` over ``rooms``, the places left in each shard, one shard after the other."""
    turn = sorted((s for s, n in rooms.items() if n), key=lambda s: hash((seed, s)))
    ends = [0]
    for s in turn:
        ends.append(ends[-1] + rooms[s])
    spot = with_bases(running_index(rows, order), F.count(F.lit(1))).withColumn("__spot", (F.col(ROW) + F.col(BASE)).cast("double")).drop(PART, ROW, BASE)
    # Range 0 ends before the first spot, range i is the i-th shard's.
    found = Bucketizer(splits=[-1.0, *map(float, ends), float("inf")], inputCol="__spot", outputCol="__turn").transform(spot)
    return found.withColumn("shard", F.get(F.array(*[F.lit(s) for s in (None, *turn)]).cast("array<int>"), F.col("__turn").cast("int"))).drop("__spot", "__turn")


def admitted(spark: SparkSession, places: DataFrame, rooms: dict[int, int], seed: int) -> DataFrame:
    """(label, to, n): the groups of ``places(node, shard, label)`` that move whole into the shard of their choice."""
    votes = places.groupBy("label", "shard").agg(F.count(F.lit(1)).alias("n"))
    asked = votes.groupBy("label").agg(F.max_by("shard", F.struct("n", F.xxhash64("label", "shard", F.lit(seed)), "shard")).alias("to"), F.max("n").alias("most"), F.sum("n").alias("n"))
    order = [F.col("most").desc(), F.col("n").desc(), F.xxhash64("label", F.lit(seed)), "label"]
    quota = F.broadcast(spark.createDataFrame(list(rooms.items()), "to int, room long"))  # one row for each shard
    return materialize(running_total(asked, ["to"], order, "n", "held").join(quota, "to").filter("held <= room").select("label", "to", "n"))


def propagate(places: DataFrame, loose: DataFrame, rooms: dict[int, int], seed: int = SEED) -> DataFrame:
    """(node, shard) of ``places(node, shard, label)`` and of ``loose(node)``; ``rooms`` says how many rows each shard takes, all in all as many as there are.

    The driver holds one number for each shard.
    """
    spark, rooms, k, done = places.sparkSession, dict(rooms), 0, []
    places = materialize(places)
    while True:
        moved = admitted(spark, places, rooms, seed + k)
        taken = moved.groupBy("to").agg(F.sum("n").alias("n")).collect()
        if not taken:
            break
        for r in taken:
            rooms[r["to"]] -= r["n"]
        done.append(materialize(places.join(moved, "label").select("node", F.col("to").alias("shard"))))
        k += 1
        left = places.join(moved.select("label"), "label", "left_anti")
        last, places = places, materialize(dealt(left, [F.xxhash64("label", F.lit(seed + k)), "label", "node"], rooms, seed + k).select("node", "shard", "label"))
        discard(last)
        discard(moved)
    rest = places.select("node", F.lit(0).alias("turn"), "label").unionByName(loose.select("node", F.lit(1).alias("turn")), allowMissingColumns=True)
    out = dealt(rest, ["turn", "label", "node"], rooms, seed + k).select("node", "shard") if any(rooms.values()) else rest.select("node", F.lit(0).alias("shard")).limit(0)
    for d in done:
        out = out.union(d)
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, node), one row for each row of ``docs``.

    Links join equal texts.  Size: bytes of the text and 16 (null text: none).  Null ids come
    first and repeated rows are separate documents.  With fewer documents than shards
    some shards stay empty; an empty table gives no rows.
    """
    body = whole(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("text_hash"))
    rows = spread(rows, ["doc_id", "text_hash"], shards)
    total = rows.count()
    rooms = {s: total // shards + (s < total % shards) for s in range(shards)}
    places = materialize(linked(rows, ["text_hash", "text_crc32", "size"], max(1, total // shards)))
    loose = rows.select("node").join(places.select("node"), "node", "left_anti")
    out = rows.drop("shard").join(propagate(places, loose, rooms, seed), "node")
    return ranked(out, ["shard"], ["node"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "node")
