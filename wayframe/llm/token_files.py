"""Token ids in bit-packed files with random access, in ascending document order.

A file holds one run of documents; a task begins another once its file has FILE_BYTES. Ids take
the fewest bits that hold the vocabulary, in blocks of BLOCK ids, each block starting on a byte;
block b starts at byte HEADER + b * block_bytes, so any id range is read by a seek and unpacked
by numpy. After the blocks come the index (per document: doc_id, null flag, its first id's
place) and a footer with its place; a document's entry is read by a seek, too.

Layout, all little-endian: header ``magic 4s, version u16, bits u16, block u32, spare u32``;
blocks; index arrays ``i8 doc_id[n], u1 null[n], i8 start[n + 1]``; footer ``i8 n_docs, i8
n_ids, i8 index_at, magic 4s``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, steps
from .tokens import encoder

MAGIC, VERSION, BLOCK = b"WFTK", 2, 1024
#: Bytes of blocks after which a task begins another file; documents that one reading step takes, and ids that it holds at once.
FILE_BYTES, READ_DOCS, READ_IDS = 256 << 20, 4096, 1 << 21
HEADER, FOOTER = struct.Struct("<4sHHII"), struct.Struct("<qqq4s")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def block_bytes(bits: int) -> int:
    return BLOCK * bits // 8


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as bits-wide integers, lowest bit first; the last byte is filled with zeros."""
    if bits % 8 == 0:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8]).tobytes()
    each = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data."""
    if bits % 8 == 0:
        out = np.zeros((n, 4), np.uint8)
        out[:, : bits // 8] = np.frombuffer(data, np.uint8, n * bits // 8).reshape(n, bits // 8)
        return out.view("<u4").ravel()
    each = np.unpackbits(np.frombuffer(data, np.uint8, (n * bits + 7) // 8), count=n * bits, bitorder="little").reshape(n, bits)
    return each.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """One file; ids come document by document, blocks go out as they fill."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.n_ids, self.at = out, bits, 0, HEADER.size
        self.doc_ids, self.nulls, self.counts, self.rest = [], [], [], np.empty(0, np.uint32)
        out.write(HEADER.pack(MAGIC, VERSION, bits, BLOCK, 0))

    def add(self, doc_ids: list[int | None], ids: list[np.ndarray]) -> None:
        self.doc_ids += [x or 0 for x in doc_ids]
        self.nulls += [x is None for x in doc_ids]
        self.counts += map(len, ids)
        held = np.concatenate([self.rest, *ids])
        whole = len(held) // BLOCK * BLOCK
        self.at += self.out.write(pack(held[:whole], self.bits)) if whole else 0
        self.rest, self.n_ids = held[whole:], self.n_ids + sum(map(len, ids))

    def close(self) -> None:
        self.at += self.out.write(pack(self.rest, self.bits)) if len(self.rest) else 0
        starts = np.concatenate([[0], np.cumsum(self.counts)])
        for values, kind in ((self.doc_ids, "<i8"), (self.nulls, "u1"), (starts, "<i8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(FOOTER.pack(len(self.counts), self.n_ids, self.at, MAGIC))
        self.out.close()


class Reader:
    """A file's documents and ids by seeks; only what is asked for is read."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        magic, version, self.bits, block, _ = HEADER.unpack(source.read_at(HEADER.size, 0))
        self.n_docs, self.n_ids, self.index_at, end = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if (magic, version, block, end) != (MAGIC, VERSION, BLOCK, MAGIC):
            raise ValueError("not a token file")

    def _values(self, at: int, first: int, last: int, kind: str) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.source.read_at((last - first) * width, at + first * width), kind)

    def documents(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of documents first .. last - 1: ids, null flags, and where they start (with the end of the last)."""
        nulls, starts = self.index_at + 8 * self.n_docs, self.index_at + 9 * self.n_docs
        return self._values(self.index_at, first, last, "<i8"), self._values(nulls, first, last, "u1").astype(bool), self._values(starts, first, last + 1, "<i8")

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin .. end - 1 of the file; only the blocks that hold them are read and unpacked."""
        if begin >= end:
            return np.empty(0, np.uint32)
        first, last = begin // BLOCK, -(-end // BLOCK)
        size = min(last * block_bytes(self.bits), self.index_at - HEADER.size) - first * block_bytes(self.bits)
        data, skip = self.source.read_at(size, HEADER.size + first * block_bytes(self.bits)), begin - first * BLOCK
        return unpack(data, self.bits, skip + end - begin)[skip:]

    def checksums(self, starts: np.ndarray) -> list[int]:
        """crc32 of each document's ids as little-endian unsigned 32-bit integers, READ_IDS ids at a time."""
        out, held, held_at = [], np.empty(0, "<u4"), 0
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            crc = 0
            while a < b:
                if a >= held_at + len(held):
                    held_at = a
                    held = self.ids(a, min(a + READ_IDS, int(starts[-1]))).astype("<u4")
                to = min(b, held_at + len(held))
                crc = zlib.crc32(held[a - held_at : to - held_at].tobytes(), crc)
                a = to
            out.append(crc)
        return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, spaced: bool = False, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes ``docs(doc_id, text, ...)`` into token files under path; returns the manifest.

    Files are in ascending doc_id order (null first; equal ids by text), file after file by
    ``part, place``. The manifest has a row for each file, ``part, place, file, n_docs, n_ids``,
    only from tasks that succeeded, so files of lost or repeated tasks are never read. A null
    text is an empty one and has the end id only. An empty table gives no files. Other columns
    are unused.
    """
    spark, bits = docs.sparkSession, bits_for(vocabulary)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, writer, name = TaskContext.get().partitionId(), 0, None, ""
        end = np.array([end_id], np.uint32)
        encode = encoder(tokenizer, spaced).encode
        store, root = fs.FileSystem.from_uri(path)

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"part": [part], "place": [place], "file": [name], "n_docs": [len(writer.counts)], "n_ids": [writer.n_ids]})

        for batch in steps(batches):
            if writer is not None and writer.at >= file_bytes:
                yield closed()
                writer, place = None, place + 1
            if writer is None:
                store.create_dir(root)
                name = f"part-{part:06d}-{place:04d}-{uuid.uuid4().hex}.tok"
                writer = Writer(store.open_output_stream(f"{root}/{name}"), bits)
            writer.add(batch.column(0).to_pylist(), [np.append(np.frombuffer(x, np.uint32), end) for x in encode(batch.column(1).to_pylist())])
        if writer is not None:
            yield closed()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = docs.select("doc_id", "text").repartitionByRange(n, order[0], F.xxhash64("text")).sortWithinPartitions(order[0], F.xxhash64("text"), order[1])
    manifest = rows.mapInArrow(write, "part long, place long, file string, n_docs long, n_ids long")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: ``doc_id, start, n_tokens, ids_crc32``, read from the files.

    start counts the ids of all documents before it, over all files. ids_crc32 is of the ids as
    little-endian unsigned 32-bit integers. A task reads runs of READ_DOCS documents by seeks,
    so neither a file nor a long document is held whole.
    """
    files, before, bases = spark.read.parquet(f"{path}/manifest"), 0, []
    for row in files.orderBy("part", "place").toLocalIterator():  # a row for each file
        bases.append((row.file, row.n_docs, before))
        before += row.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, base, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{root}/{name}") as source:
                    r = Reader(source)
                    ids, nulls, starts = r.documents(first, last)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(r.checksums(starts), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not bases:
        return spark.createDataFrame([], schema)
    runs = spark.createDataFrame(bases, "file string, n_docs long, base long").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(READ_DOCS).cast("long"))).alias("first"))
    runs = runs.select("file", "base", "first", F.least(F.col("first") + READ_DOCS, "n_docs").alias("last"))
    return runs.repartition("file", "first").mapInArrow(read, schema)


def encode_documents(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, spaced: bool = False) -> DataFrame:
    """Writes token files into the shared folder and reads them back."""
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write_token_files(docs, path, tokenizer, vocabulary, end_id, spaced)
    return read_token_files(spark, path)
