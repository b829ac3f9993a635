"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, lsh_forest, multiset_hash, packing, quality_fm, quality_rules, secrets, suffix_dedup, token_files, url_trees
from .common import table
from .oracle import ORACLE_SQL  # noqa: F401

#: Ids of the word-level vocabulary, special tokens included; the id that ends a document.
WORD_VOCABULARY, END_ID = 49_408, 1


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), WORD_VOCABULARY, END_ID)


def op2_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Verdict and rule: a host and its subdomains, and how the path begins.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op3_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID, with_ids=False)


def op6_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def op7_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op8_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edited_likeness(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_files, op2_factorisation_machine, op3_url_trees, op4_lsh_forest, op5_pow2_packing, op6_ngram_ratio, op7_bwt_dedup, op8_secret_novelty, op9_bpe_automaton, op10_multiset_hash)}
