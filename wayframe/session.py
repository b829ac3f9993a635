"""Spark session settings and the shared folder for tables between rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine: few shuffle partitions, adaptive execution, UTC."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("wayframe")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; on one machine, where it may be unset, a local folder. RuntimeError if a cluster has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, **counts: Column) -> tuple[DataFrame, str, dict[str, int]]:
    """The rows as a table in the shared folder, so that lineage ends and lost executors don't lose it; its path; and aggregates over the rows, taken as they are written."""
    path, seen = shared_path(df.sparkSession, purpose), Observation()
    (df.observe(seen, *[c.alias(k) for k, c in counts.items()]) if counts else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path, seen.get if counts else {}


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder that nothing reads any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
