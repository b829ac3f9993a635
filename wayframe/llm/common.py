"""What the corpus operators share: the shared folder, table reading, batches of rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root

#: Text bytes that one step of a Python worker handles together.
STEP_BYTES = 2 << 20


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and the session runs on one machine, as in tests, a local
    folder is taken; a cluster without it is an error.
    """
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again (cuts the lineage)."""
    spark = df.sparkSession
    path = path or shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, path: str) -> None:
    """Deletes a table under the shared folder that nothing reads any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nested(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text``: all columns but text in one struct, so that names of steps can't clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")


def unnested(rows: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of like from ``row, text``; changed: other values for some of them."""
    each = lambda c: changed[c] if c in changed else F.col("text") if c == "text" else F.col("row").getField(c)
    return rows.select(*[each(c).alias(c) for c in like.columns])


def recounted(rows: DataFrame, like: DataFrame, flag: str) -> DataFrame:
    """unnested, with n_chars (where like has such a column) counted anew where the flag holds."""
    if "n_chars" not in like.columns:
        return unnested(rows, like)
    n = F.when(F.col(flag), F.char_length("text").cast(like.schema["n_chars"].dataType)).otherwise(F.col("row").getField("n_chars"))
    return unnested(rows, like, n_chars=n)


def steps(batches: Iterator[pa.RecordBatch], text_at: int = -1) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows whose texts take about STEP_BYTES (one row at least).

    text_at: the column of texts.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = batch.column(text_at).cast(pa.large_string()) if pa.types.is_string(batch.column(text_at).type) else batch.column(text_at)
        total, begin, lengths = 0, 0, pa.compute.binary_length(ends).to_pylist()
        for i, n in enumerate(lengths):
            total += n or 0
            if total >= STEP_BYTES:
                yield batch.slice(begin, i + 1 - begin)
                total, begin = 0, i + 1
        if begin < batch.num_rows:
            yield batch.slice(begin)
