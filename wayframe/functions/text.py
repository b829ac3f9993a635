"""Text rewriting as column functions: detect, replace, tidy. No Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches' group, in order."""
    return F.regexp_extract_all(text, F.lit(P.FLAGS + pattern), F.lit(group))


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, P.FLAGS + pattern, by)


def tidy_spaces(text: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(replaced(text, r"\s+", " "))


def tidy_commas(text: Column) -> Column:
    """Spaces, then commas: none after a space, doubled ones once, none in front. One pass."""
    return replaced(replaced(replaced(tidy_spaces(text), r"\s+,", ","), r",\s*,", ","), r"^\s*,\s*", "")


def tidy_all(text: Column) -> Column:
    """tidy_commas, and no comma at the end."""
    return replaced(tidy_commas(text), r",\s*$", "")


def clause(label: str, values: Column) -> Column:
    """``label: a, b``, or null for none."""
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", ")))


def counted(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.size(values).cast("string"), F.lit(" removed")))


def summary(*clauses: Column) -> Column:
    """Clauses joined by ``; ``; null if there is none."""
    return F.nullif(F.concat_ws("; ", *clauses), F.lit(""))


def range_text(matches: Column, pattern: str, unit: bool) -> Column:
    """``a-b unit`` or ``a unit`` of each match of a distance pattern."""

    def one(m: Column) -> Column:
        part = lambda k: F.regexp_extract(m, P.FLAGS + pattern, k)
        return F.concat(part(1), F.when(part(2) != "", F.concat(F.lit("-"), part(2))).otherwise(""), *([F.lit(" "), part(3)] if unit else []))

    return F.transform(matches, one)


def degrade(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``t1_text, t1_removed, t2_text, t2_removed, t3_text, t3_removed`` for the column text.

    Each detection sees the text as earlier rewrites left it. ``removed`` is null where a
    strategy found nothing; a null text gives nulls. Steps are columns of their own, so that no
    rewrite is evaluated twice.
    """
    r = rows.withColumns({"_a0": F.col(text), "_b0": F.col(text), "_c0": F.col(text)})
    r = r.withColumns({
        "_cardinal": found(F.col("_a0"), P.CARDINAL), "_a1": replaced(replaced(F.col("_a0"), P.CARDINAL + r"\s+of\b", "from"), P.CARDINAL, ""),
        "_past": found(F.col("_b0"), P.PAST_LANDMARK, 0), "_b1": replaced(F.col("_b0"), P.PAST_LANDMARK, ""),
        "_blocks": found(F.col("_c0"), P.BLOCK_COUNT, 0), "_c1": replaced(F.col("_c0"), P.BLOCK_COUNT, "some $3"),
    })
    r = r.withColumns({
        "_ordinal": found(F.col("_a1"), P.ORDINAL_DIRECTION), "_a2": replaced(F.col("_a1"), P.ORDINAL_DIRECTION, ""),
        "_near": found(F.col("_b1"), P.NEAR_LANDMARK, 0), "_b2": replaced(F.col("_b1"), P.NEAR_LANDMARK, ""),
        "_metric": found(F.col("_c1"), P.METRIC, 0), "_c2": replaced(F.col("_c1"), P.METRIC, "some distance"),
    })
    r = r.withColumns({
        "_distance": found(F.col("_a2"), P.DISTANCE, 0), "_a3": replaced(F.col("_a2"), P.DISTANCE, "some distance"),
        "_corner": found(F.col("_b2"), P.INTERSECTION, 0), "_b3": replaced(F.col("_b2"), P.INTERSECTION, ""),
        "_exactly": F.col("_c2").rlike(P.FLAGS + P.EXACTLY), "_c3": replaced(F.col("_c2"), P.EXACTLY + r"\s+", ""),
    })
    r = r.withColumns({
        "_relative": found(F.col("_a3"), P.RELATIVE), "_a4": replaced(F.col("_a3"), P.RELATIVE, "near"),
        "_number": found(F.col("_c3"), P.ORDINAL_NUMBER), "_c4": replaced(F.col("_c3"), P.ORDINAL_NUMBER, "a"),
    })
    once = lambda c: F.array_distinct(c)
    made = r.withColumns({
        "t1_text": tidy_commas(F.col("_a4")), "t2_text": tidy_all(F.col("_b3")), "t3_text": tidy_spaces(F.col("_c4")),
        "t1_removed": summary(clause("Cardinal directions", once("_cardinal")), clause("Ordinal directions", once("_ordinal")), clause("Distances", range_text(F.col("_distance"), P.DISTANCE, True)), clause("Relative terms", once("_relative"))),
        "t2_removed": summary(counted("Intermediate 'past' landmarks", F.col("_past")), counted("Secondary 'near' landmarks", F.col("_near")), counted("Street intersections", F.col("_corner"))),
        "t3_removed": summary(clause("Exact block counts", range_text(F.col("_blocks"), P.BLOCK_COUNT, False)), counted("Exact distances", F.col("_metric")), F.when(F.col("_exactly"), F.lit("Precision marker: 'exactly'")), clause("Ordinal positions", F.col("_number"))),
    })
    return made.select(*rows.columns, "t1_text", "t1_removed", "t2_text", "t2_removed", "t3_text", "t3_removed")
