"""From raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayframe.llm import lsh_forest, packing, quality_rules, secrets, suffix_dedup
from wayframe.llm.common import discard, shared_dir, stored, table
from wayframe.llm.queries import END_ID


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Trusted text: documents labelled good."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.kept_documents(docs, trusted)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return lsh_forest.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that occur elsewhere are cut out; every document stays."""
    return suffix_dedup.remove_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths up to 2048, with their ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("near copies", drop_near_copies),
    ("repeated strings", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: No SQL: the stages hash n-grams, estimate similarities and encode tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. A stage's table is deleted once the next one is written; the last but one stays, as the result reads it."""
    docs, paths = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        paths.append(shared_dir(spark, name.replace(" ", "-")))
        docs = stored(stage(spark, docs, sf_dir), name, paths[-1])
        for path in paths[:-1]:
            discard(docs, path)
        del paths[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
