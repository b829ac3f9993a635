"""Variants of instructions: sampling, expansion, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import STRATEGIES
from ..functions.text import degrade


def sample_exactly(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed; all rows if there are no more. Plans as a top-n by the md5 of seed and id, without a full sort."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(n)


def expand(instructions: DataFrame) -> DataFrame:
    """Up to three variants of each instruction, those whose strategy removed something: columns of schemas.VARIANTS and strategy_no. One scan, one generator."""
    rows = degrade(instructions, "instruction")
    kinds = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(name).alias("name"), F.col(f"t{k}_text").alias("text"), F.col(f"t{k}_removed").alias("removed"), F.lit(impact).alias("impact")) for k, (name, impact) in enumerate(STRATEGIES, 1)])
    each = rows.select("*", F.explode(kinds).alias("v")).where("v.removed IS NOT NULL")
    return each.select(
        F.col("id").alias("instruction_id"), "region", F.col("instruction").alias("original_instruction"), F.col("v.name").alias("strategy_applied"), F.col("v.text").alias("underspecified_instruction"),
        F.col("v.removed").alias("removed_information"), F.col("v.impact").alias("expected_impact"), F.col("target_lat").alias("ground_truth_lat"), F.col("target_lon").alias("ground_truth_lon"), F.col("v.no").alias("strategy_no"),
    )


def strategy_shares(variants: DataFrame) -> DataFrame:
    """Variants of each strategy and their share in percent, the most frequent first."""
    counts = variants.groupBy("strategy_applied").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over a row for each strategy
    return counts.select("strategy_applied", "n", F.round(F.col("n") / total * 100, 1).alias("percent")).orderBy(F.desc("n"), "strategy_applied")


def quality_summary(variants: DataFrame) -> DataFrame:
    """One row: variants, different instructions, variants of each strategy."""
    of = [F.count(F.when(F.col("strategy_no") == k, 1)).alias(f"n_strategy_{k}") for k in (1, 2, 3)]
    return variants.agg(F.count("*").alias("n_variants"), F.countDistinct("instruction_id").alias("n_instructions"), *of)


def head(variants: DataFrame, n: int = 3) -> DataFrame:
    return variants.orderBy("instruction_id", "strategy_no").limit(n)


def report_lines(variants: DataFrame) -> list[str]:
    """The quality report as text: totals and shares."""
    s = quality_summary(variants).first()
    shares = [f"{r.strategy_applied}: {r.n} ({r.percent:.1f}%)" for r in strategy_shares(variants).collect()]  # a row for each strategy
    return [f"Variants: {s.n_variants}", f"Instructions: {s.n_instructions}", *shares]
