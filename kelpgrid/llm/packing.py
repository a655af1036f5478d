"""Packing by concatenating and cutting.

Pass 1 encodes every text where it lies and keeps, with its ids, where it starts in
its partition.  Prefix sums over the partitions' totals (one row each) give every
partition's base, so every id has a place in one global stream.  Pass 2 cuts the stream
at multiples of the window; a document that crosses a cut leaves a boundary record: a
piece on either side.  Only the last window is not full.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgrid.llm.common import BASE, PART, with_bases
from kelpgrid.llm.encoding import Vocabulary, groups_of, worker_encoder
from kelpgrid.session import materialize

WINDOW = 2048
END = 1
STREAM = f"doc_id long, ids binary, first long, n_tokens long, width int, {PART} int"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encode(vocabulary: Vocabulary, end: int, name: str):
    def run(batches):
        encoder, first, part = worker_encoder(vocabulary, name), 0, TaskContext.get().partitionId()
        width = encoder.dtype.itemsize
        for batch in batches:
            at = 0
            for texts in groups_of(t.as_py() for t in batch.column(1)):
                ids = encoder.encode(texts, end)
                n = np.array([len(x) for x in ids], np.int64) // width
                starts = first + np.cumsum(n) - n
                first += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(ids)), pa.array(ids, pa.binary()), pa.array(starts), pa.array(n),
                     pa.array(np.full(len(ids), width, np.int32)), pa.array(np.full(len(ids), part, np.int32))],
                    names=["doc_id", "ids", "first", "n_tokens", "width", PART])
                at += len(ids)

    return run


def _cut(window: int):
    def run(batches):
        for batch in batches:
            rows = [batch.column(i).to_pylist() for i in range(5)]
            out = [[] for _ in range(7)]
            for doc, ids, n, width, place in zip(*rows):
                ids, start = np.frombuffer(ids, f"<u{width}"), 0
                while start < n:
                    seq, offset = divmod(place + start, window)
                    length = min(window - offset, n - start)
                    crc = zlib.crc32(ids[start:start + length].astype("<u4").tobytes())
                    for column, value in zip(out, (doc, start, length, crc, n, seq, offset)):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[c.split()[0] for c in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, vocabulary: Vocabulary, window: int = WINDOW, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every text, null ones as empty, is its ids and the end id, so no document is without a
    piece; every id lies in exactly one.  Rows with null or repeated ids are packed like any
    other.  An empty table gives no rows.  Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stream = materialize(rows.mapInArrow(_encode(vocabulary, end, uuid.uuid4().hex), STREAM))
    placed = with_bases(stream, F.sum("n_tokens"))
    placed = placed.select("doc_id", "ids", "n_tokens", "width", (F.col("first") + F.col(BASE)).alias("place"))
    return placed.mapInArrow(_cut(window), PIECES)
