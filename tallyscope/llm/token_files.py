"""Token ids as flat binary files with 64-bit document offsets.

A set is a folder with, for each shard, ``.tok`` (unsigned 16- or 32-bit ids),
``.off`` (signed 64-bit, documents + 1: ids of the shard before each
document, then all) and ``.doc`` (signed 64-bit document ids), all
little-endian, and ``manifest``, a Parquet table with a row for each shard: its place, name, numbers of
documents, ids and null document ids, the type of its ids, and the ids before it (``base``), prefix sums over the shards.
"""

from __future__ import annotations

import os
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, python_ready, staged
from .encoding import encoder, slices

MANIFEST = "manifest"
SHARDS = "part long, name string, n_docs long, n_tokens long, n_null long, dtype string"
#: Text of one shard; how many shards there are follows the table's size.
SHARD_BYTES = 16 << 20
LEAST_SHARDS = 16
#: Shards whose sums are added up in one step.
RUN = 1024


def filesystem(uri: str):
    """(file system, path, is it local) of a folder's URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/"), True
    if "://" not in uri:
        return fs.LocalFileSystem(), uri, True
    found, path = fs.FileSystem.from_uri(uri)
    return found, path, False


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", drops_spaces: bool = False, dtype: str = "<u2", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode whole texts in ascending id order, end each with ``end_id``, and write the files.

    Documents are dealt to range partitions of their id; each task streams
    its sorted documents to files whose names hold the task attempt, so a
    retried or doubled task never mixes with another, and only finished
    attempts reach the manifest: a task's row is written by Spark. The shards' bases
    are prefix sums in two steps, over runs of shards and within each; the driver sees the text's size alone. Memory is bounded by the slices.

    Null or empty text: only the end id. Null ids stand first; equal ids stand
    in order of text. No rows: a manifest without ids. An id that ``dtype``
    can't hold is an error.
    """
    most = np.iinfo(dtype).max

    def write(batches):
        ctx = TaskContext.get()
        files, root, _ = filesystem(folder)
        name = f"shard-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        enc, end, at, n_docs, n_null = encoder(tokenizer_path, drops_spaces), np.array([end_id], "<u4").tobytes(), 0, 0, 0
        with files.open_output_stream(f"{root}/{name}.tok") as tok, files.open_output_stream(f"{root}/{name}.off") as off, files.open_output_stream(f"{root}/{name}.doc") as doc:
            off.write(np.array([0], "<i8").tobytes())
            for batch in batches:
                ids = batch.column(0)
                n_null += ids.null_count
                for start, texts in slices(batch, 1):
                    made = [x + end for x in enc.encode(texts)]
                    values = np.frombuffer(b"".join(made), "<u4")
                    if values.max(initial=0) > most:
                        raise ValueError(f"token id {values.max()} does not fit {dtype}")
                    tok.write(values.astype(dtype).tobytes())
                    ends = at + np.cumsum([len(x) // 4 for x in made], dtype="<i8")
                    off.write(ends.astype("<i8").tobytes())
                    doc.write(ids.slice(start, len(texts)).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    at, n_docs = int(ends[-1]), n_docs + len(texts)
        yield pa.RecordBatch.from_pydict({"part": [ctx.partitionId()], "name": [name], "n_docs": [n_docs], "n_tokens": [at], "n_null": [n_null], "dtype": [dtype]})

    files, root, _ = filesystem(folder)
    files.create_dir(root, recursive=True)
    rows = python_ready(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    placed = rows.repartitionByRange(max(LEAST_SHARDS, -(-size // shard_bytes)), "id").sortWithinPartitions("id", "text")
    shards = staged(placed.mapInArrow(write, SHARDS), "token-shards")
    ran = shards.withColumn("run", F.floor(F.col("part") / RUN).cast("long"))
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ran.groupBy("run").agg(F.sum("n_tokens").alias("n_tokens")).select("run", earlier(Window.orderBy("run")).alias("base"))
    within = ran.withColumn("here", earlier(Window.partitionBy("run").orderBy("part")))
    within.join(bases, "run").select(*shards.columns, (F.col("base") + F.col("here")).alias("base")).write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")
    discard(shards)


class Ranges:
    """A file of numbers by slices: a memory map where the file is local; elsewhere each slice is read by itself."""

    def __init__(self, files, path: str, local: bool, dtype: str):
        self.dtype = np.dtype(dtype)
        if not local:
            self.file = files.open_input_file(path)
        self.map = (np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)) if local else None

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[at]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((at.stop - at.start) * size, at.start * size), self.dtype)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, read from the files alone: doc_id, start, n_tokens, ids_crc32.

    A task reads the shards whose manifest rows it gets, about one each; ids are mapped, or read by ranges where the file isn't local, and the
    checksum (of the ids as little-endian unsigned 32-bit integers) goes
    document by document.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    manifest = spark.read.schema(f"{SHARDS}, base long").parquet(f"{folder}/{MANIFEST}").where("n_docs > 0")

    def read(batches):
        files, root, local = filesystem(folder)
        for s in (r for batch in batches for r in batch.to_pylist()):
            tok, off, doc = (Ranges(files, f"{root}/{s['name']}.{x}", local, t) for x, t in (("tok", s["dtype"]), ("off", "<i8"), ("doc", "<i8")))
            for a in range(0, s["n_docs"], 4096):
                b = min(a + 4096, s["n_docs"])
                at = off[a : b + 1]
                crc = [zlib.crc32(tok[int(i) : int(j)].astype("<u4").tobytes()) for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(doc[a:b]), pa.int64(), mask=np.arange(a, b) < s["n_null"]), pa.array(s["base"] + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    ship(spark)
    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, schema)


assert sys.byteorder == "little", "files are mapped as they are"
