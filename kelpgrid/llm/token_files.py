"""Token-id files: flat unsigned integers with 64-bit document offsets.

A set is a folder with three files for each partition, in ascending id order across
partitions:

* ``<name>.ids``: token ids of its documents one after another, little-endian, 2 bytes if the
  vocabulary has at most 65,536 ids, else 4;
* ``<name>.off``: documents + 1 little-endian signed 64-bit offsets into the ids, counted in ids;
* ``<name>.doc``: document ids, little-endian signed 64-bit; the least such number stands for null.

Tasks write under a name of their own attempt and rename when all bytes are there, so a
repeated task leaves whole files only.  The manifest table holds one row for each partition;
its bases (ids before the partition) are prefix sums over those rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.llm.encoding import Vocabulary, groups_of, worker_encoder
from kelpgrid.session import materialize, shared_folder

END = 2
NULL_ID = np.iinfo(np.int64).min
MANIFEST = "part long, name string, n_docs long, n_tokens long, width int"


def _open_store(uri: str):
    """File system and path of a shared folder; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _local(uri: str) -> str:
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _writer(folder: str, vocabulary: Vocabulary, end: int, run: str):
    def write(batches):
        store, path = _open_store(folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        part = task.partitionId()
        name, draft = f"part-{part:05d}", f"draft-{part:05d}-{uuid.uuid4().hex}"
        encoder = worker_encoder(vocabulary, run)
        counts, docs = [], []
        with store.open_output_stream(f"{path}/{draft}.ids") as out:
            for batch in batches:
                docs.append(batch.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype("<i8"))
                for texts in groups_of(t.as_py() for t in batch.column(1)):
                    for ids in encoder.encode(texts, end):
                        out.write(ids)
                        counts.append(len(ids) // encoder.dtype.itemsize)
        if not counts:
            store.delete_file(f"{path}/{draft}.ids")
            return
        offsets = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype("<i8")
        for kind, data in (("off", offsets.tobytes()), ("doc", np.concatenate(docs).tobytes())):
            with store.open_output_stream(f"{path}/{draft}.{kind}") as out:
                out.write(data)
        for kind in ("off", "doc", "ids"):
            store.move(f"{path}/{draft}.{kind}", f"{path}/{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([len(counts)]), pa.array([int(offsets[-1])]),
                                          pa.array([encoder.dtype.itemsize], pa.int32())], names=["part", "name", "n_docs", "n_tokens", "width"])

    return write


def write_token_files(docs: DataFrame, vocabulary: Vocabulary, folder: str, end: int = END,
                      doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every whole text into ``folder`` in ascending id order; the manifest (part, name, n_docs, n_tokens, width, base).

    Null texts count as empty and hold the end id alone.  Null ids come first; rows that repeat
    an id are ordered by text.  An empty table gives an empty manifest.  Other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(rows.mapInArrow(_writer(_local(folder), vocabulary, end, uuid.uuid4().hex), MANIFEST))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_tokens(folder: str, name: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids) of one partition, memory-mapped where the store is a local or mounted folder."""
    from pyarrow import fs

    store, path = _open_store(_local(folder))
    found = []
    for kind, dtype in (("ids", f"<u{width}"), ("off", "<i8"), ("doc", "<i8")):
        if isinstance(store, fs.LocalFileSystem):
            found.append(np.memmap(f"{path}/{name}.{kind}", dtype, "r"))
        else:
            with store.open_input_file(f"{path}/{name}.{kind}") as f:
                found.append(np.frombuffer(f.read(), dtype))
    return tuple(found)


def _reader(folder: str):
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, off, doc = open_tokens(folder, row["name"], row["width"])
                for i in range(0, len(doc), 4096):
                    span = off[i:i + 4097]
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(span[:-1].tolist(), span[1:].tolist())]
                    own = np.array(doc[i:i + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NULL_ID), pa.array(span[:-1] + row["base"]), pa.array(np.diff(span)), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "part").mapInArrow(_reader(_local(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
