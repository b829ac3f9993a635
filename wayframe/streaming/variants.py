"""Variants of a stream of instructions: the expansion has no state, so the same plan serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators.variants import expand


def stream_variants(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming table of variants for JSON-lines instruction files that arrive in folder."""
    return expand(spark.readStream.schema(schemas.INSTRUCTIONS).json(folder))


def run_once(variants: DataFrame, out: str, checkpoint: str) -> None:
    """Writes what is there as Parquet, exactly once, and ends."""
    variants.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
