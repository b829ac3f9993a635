"""Instruction tables: readers by file kind, the built-in sample, the variant writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas

# The sample instructions.
SAMPLE = [
    ("manhattan_001", "Manhattan", "2 blocks north of Central Park and 1 block east of the museum", 40.7678, -73.9712),
    ("manhattan_002", "Manhattan", "East of the library, past the fountain, near the Y-shaped intersection", 40.7489, -73.9680),
    ("brooklyn_001", "Brooklyn", "Exactly 3 blocks south on Atlantic Avenue", 40.6782, -73.9442),
    ("manhattan_003", "Manhattan", "Between the post office and the park, closer to the park", 40.7580, -73.9855),
    ("queens_001", "Queens", "At the corner of Queens Blvd and 42nd St, north of the subway station", 40.7433, -73.9196),
    ("manhattan_004", "Manhattan", "3-4 blocks from Columbus Circle, north of a police station", 40.7712, -73.9820),
    ("manhattan_005", "Manhattan", "Walk north on 8th Ave, at a parking entrance a block north of a police station", 40.7645, -73.9890),
]
#: Quotes are doubled, lines may break within them, and white space is kept.
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Rows of a written CSV file. As lines may break within quotes, a file is read by one task.
CSV_ROWS = 50_000


def sample_instructions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE, schemas.INSTRUCTIONS)


def read_instructions(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Instructions of a ``.json`` (an array of records), ``.jsonl`` (a record a line, read in parallel), ``.csv`` or ``.parquet`` path; without a path the sample; ValueError for other kinds."""
    if path is None:
        return sample_instructions(spark)
    reader = spark.read.schema(schemas.INSTRUCTIONS)
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    if path.endswith(".jsonl"):
        return reader.json(path)
    if path.endswith(".csv"):
        return reader.options(**CSV, enforceSchema=False).csv(path)
    if path.endswith(".parquet"):
        return reader.parquet(path)
    raise ValueError(f"instructions can't be read from this kind of file: {path}")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """What write_variants wrote."""
    return spark.read.schema(schemas.VARIANTS).options(**CSV, enforceSchema=False).csv(path)


def write_csv(rows: DataFrame, path: str, most_rows: int = 0) -> None:
    """CSV with a header, quotes doubled; most_rows: files of as many rows at most (0: of any size)."""
    options = {k: v for k, v in CSV.items() if k != "multiLine"}
    rows.write.options(**options, maxRecordsPerFile=most_rows).mode("errorifexists").csv(path)


def write_variants(variants: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header, quotes doubled, sorted within files by instruction and strategy, in files of CSV_ROWS rows at most. files: instead as many files at most, of any size (1 for a single file; small tables only)."""
    rows = variants if files is None else variants.coalesce(files)
    write_csv(rows.sortWithinPartitions("instruction_id", "strategy_no").drop("strategy_no"), path, CSV_ROWS if files is None else 0)
