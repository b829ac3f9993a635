"""Packing by power-of-two decomposition.

A document of n ids is cut into as many pieces of LENGTH ids as fit, then into pieces by the
binary digits of what remains, longest first. Pieces of one length form a bucket, and each
piece is a sequence of its own: no sequence holds two documents, and none needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps
from .tokens import encoder


def piece_lengths(n: int, length: int) -> list[int]:
    """The lengths that n ids are cut into; length is a power of two."""
    return [length] * (n // length) + [1 << b for b in range(length.bit_length() - 2, -1, -1) if n % length >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, spaced: bool = True, with_ids: bool = True) -> DataFrame:
    """Sequences from ``docs(doc_id, text, ...)``: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with_ids, ``ids`` (little-endian unsigned 32-bit).

    length: a power of two, the longest sequence; the column ``length`` is the bucket, by
    which a writer may partition. A null text is an empty one: its document is the end id
    alone. A null doc_id stays null; repeated rows are packed each. An empty table gives no
    rows. sequence_id is unique; its values follow the input's partitions. No row moves
    between partitions.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, spaced).encode, np.array([end_id], "<u4").tobytes()
        for batch in steps(batches):
            ids, start, size, crc, docs_n, data = [], [], [], [], [], []
            for doc_id, x in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                x += end
                at, n = 0, len(x) // 4
                for m in piece_lengths(n, length):
                    piece = x[4 * at : 4 * (at + m)]
                    ids.append(doc_id), start.append(at), size.append(m), crc.append(zlib.crc32(piece)), docs_n.append(n)
                    if with_ids:
                        data.append(piece)
                    at += m
            columns = {k: pa.array(v, pa.int64()) for k, v in (("doc_id", ids), ("start", start), ("length", size), ("ids_crc32", crc), ("doc_tokens", docs_n))}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(data, pa.binary())} if with_ids else {}))

    pieces = docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder for each length; rows stay in their tasks, which write one file a length each."""
    packed.write.partitionBy("length").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length, read from its folder alone; ``ids`` as arrays of ints (of packed with_ids)."""
    rows = spark.read.parquet(path).where(F.col("length") == length)
    place = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, place):
            flat = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4").astype(np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * length), pa.array(flat))
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", ids)

    names = [f"`{f.name}` array<long>" if f.name == "ids" else f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(run, ", ".join(names))

