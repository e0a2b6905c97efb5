"""Operator 7: token-ID files. Texts become ids, ids become files of range-coded blocks, and files are read back.

A file: magic, the documents' ids (doc_id, or none) and lengths as a zlib table, then the blocks of all their ids by
rangecoder. Files hold whole documents in ascending doc_id order (null first; equal doc_ids in any order)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder
from .common import arrow, batch, materialize, scratch, write_bytes
from .tokens import crc, encoded

MAGIC = b"TIDF0001"
END_ID = 2
_MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"
_READ = "file string, row long, doc_id long, file_start long, n_tokens long, ids_crc32 long"


def pack_file(doc_ids: list[int | None], docs: list[bytes]) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    lengths = np.array([len(d) // 4 for d in docs], "<u4")
    table = zlib.compress(known.tobytes() + keys.tobytes() + lengths.tobytes(), 1)
    return MAGIC + struct.pack("<II", len(docs), len(table)) + table + rangecoder.encode(np.frombuffer(b"".join(docs), "<u4"))


def unpack_file(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    if data[:8] != MAGIC:
        raise ValueError("not a token-ID file")
    n, size = struct.unpack_from("<II", data, 8)
    table = zlib.decompress(data[16 : 16 + size])
    known, keys, lengths = np.frombuffer(table[:n], np.uint8), np.frombuffer(table[n : 9 * n], "<i8"), np.frombuffer(table[9 * n :], "<u4")
    ids = rangecoder.decode(data[16 + size :])
    return [int(k) if f else None for f, k in zip(known, keys)], np.split(ids, np.cumsum(lengths.astype(np.int64))[:-1]) if n else []


def write_files(docs: DataFrame, folder: str, tokenizer: str, keeps_space: bool, end_id: int = END_ID, ids_per_file: int = 8 << 20) -> DataFrame:
    """Write doc_id, text as token-ID files below folder; give the manifest: part, seq, file, n_docs, n_tokens, start.

    A null or empty text has only the end id; repeated rows are repeated documents; other columns are ignored. A task
    that is run again writes files of other names, and the manifest names only those of the tasks that counted."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, schema = TaskContext.get(), arrow(_MANIFEST)
        keys, held, size, seq = [], [], 0, 0

        def flush():
            nonlocal keys, held, size, seq
            name = f"part-{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.tid"
            write_bytes(f"{folder}/{name}", pack_file(keys, held))
            row = batch({"part": [task.partitionId()], "seq": [seq], "file": [name], "n_docs": [len(held)], "n_tokens": [size // 4]}, schema)
            keys, held, size, seq = [], [], 0, seq + 1
            return row

        for group, texts in encoded(batches, tokenizer, keeps_space, end_id):
            for key, ids in zip(group, texts):
                if held and size + len(ids) > 4 * ids_per_file:
                    yield flush()
                keys.append(key)
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()

    # rows of one doc_id, or of none, may take several ranges
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    manifest = materialize(ordered.mapInArrow(write, _MANIFEST), "manifest")
    # one row a file, which stays small: a file holds millions of ids
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Decode every file of the manifest: doc_id, start, n_tokens, ids_crc32 of each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(_READ)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                keys, docs = unpack_file(content.as_py())
                lengths = np.array([len(d) for d in docs], np.int64)
                yield batch({"file": [path.rpartition("/")[2]] * len(docs), "row": np.arange(len(docs)), "doc_id": keys, "file_start": np.cumsum(lengths) - lengths, "n_tokens": lengths, "ids_crc32": [crc(d.tobytes()) for d in docs]}, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tid").load(folder).select("path", "content")
    return files.mapInArrow(read, _READ).join(manifest.select("file", "start"), "file").select("doc_id", (F.col("start") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, keeps_space: bool = True, end_id: int = END_ID) -> DataFrame:
    """Write docs (doc_id, text) as token-ID files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    No documents: no files and no rows."""
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    manifest = write_files(docs, folder, tokenizer, keeps_space, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_files(spark, folder, manifest)
