"""Quality rules: counts of words, symbols and repeats, and a hashed n-gram likelihood ratio.

Single words and word pairs are hashed into BUCKETS buckets. Two multinomials are counted, one
over trusted documents (those labelled good) and one over the whole corpus, both over all
their documents. A document's score is the mean over its n-grams of log(trusted / corpus), so
length doesn't matter; a document scoring under the threshold is rejected.

Only DataFrame functions: both counts are partial aggregates of at most BUCKETS rows a task,
and the table of BUCKETS ratios returns to the plan as one constant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets, a power of two; the ratio table has that many numbers at every corpus size.
BUCKETS = 8192
#: Least mean log ratio (nats an n-gram) of a kept document: its n-grams may be this much likelier in the corpus than in trusted text.
THRESHOLD = -0.1
# A word, symbols, the least number of words, the most words in repeated windows (percent), words in a window.
WORD, SYMBOLS, LEAST_WORDS, MOST_REPEATED, WINDOW = r"[^\x20\x09-\x0D]+", "#*$%&|<>", 10, 20, 5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def ngrams_of(words: Column) -> Column:
    """Bucket numbers of all words and word pairs: the low bits of crc32, of a pair's words with a space between them."""
    bucket = lambda x: F.crc32(x.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(words, bucket), pairs)


def window_hashes(words: Column) -> Column:
    """Hashes of all 5-word windows; null if there are fewer words."""
    n = F.size(words)
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))


def covered_words(placed: str) -> Column:
    """Words in windows that occur twice or more.

    placed: the hashes with their places, sorted. Neighbours with equal hashes give the places
    of repeated windows; a fold over these places, in order, adds up the words they cover.
    """

    def again(x: Column, k: Column) -> Column:  # F.get counts from 0 and is null outside
        return F.coalesce(F.get(placed, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(placed, k + 1)["h"] == x["h"], F.lit(False))

    places = F.array_sort(F.transform(F.filter(placed, again), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n")), lambda s: s["n"])


def _counts(docs: DataFrame, trusted: DataFrame) -> tuple[dict[int, tuple[int, int]], int, int]:
    """By bucket: n-grams of the corpus and of trusted documents; with their sums."""
    marks = trusted.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct().withColumn("_good", F.lit(1))
    marked = docs.select("doc_id", "text").join(marks.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left").select("text", F.coalesce("_good", F.lit(0)).alias("_good"))
    grams = marked.select("_good", words_of(F.col("text")).alias("_rule_w")).select("_good", F.explode(ngrams_of(F.col("_rule_w"))).alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("_good").alias("good")).collect()  # BUCKETS rows at most
    return {r.b: (r.n, r.good) for r in rows}, sum(r.n for r in rows), sum(r.good for r in rows)


def ratio_table(docs: DataFrame, trusted: DataFrame) -> list[float] | None:
    """log(trusted share / corpus share) of each bucket, each count plus one; None without trusted n-grams."""
    counts, n, good = _counts(docs, trusted)
    if not good:
        return None
    share = lambda x, total: math.log((x + 1) / (total + BUCKETS))
    return [share(counts.get(b, (0, 0))[1], good) - share(counts.get(b, (0, 0))[0], n) for b in range(BUCKETS)]


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs and the columns ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed, score, kept``.

    trusted: ``doc_id`` of good documents. A null text has no words and fails, like any text
    under ten words. Without trusted documents score is null and base_failed decides alone. A
    null doc_id is never trusted; repeated rows are judged each; other columns stay, and columns
    of docs named like new ones are replaced. An empty table gives no rows.
    """
    table = ratio_table(docs, trusted)
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    rows = docs.withColumn("_rule_w", words_of(F.col("text"))).withColumn("_rule_lines", lines)
    rows = rows.withColumn("_rule_h", window_hashes(F.col("_rule_w")))
    repeats = F.size(F.array_distinct("_rule_h")) < F.size("_rule_h")
    # The partition number, used below, keeps filters on the results above this step: pushed further
    # down, they would hold these expressions anew for each element that they are used on.
    rows = rows.withColumns({"_rule_placed": F.when(repeats, F.array_sort(F.transform("_rule_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))), "_rule_part": F.spark_partition_id()})
    covered = F.when(F.col("_rule_placed").isNotNull() & (F.col("_rule_part") >= 0), covered_words("_rule_placed"))
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    rows = rows.withColumns({
        "n_words": F.size("_rule_w").cast("long"), "word_chars": F.char_length(bare).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_rule_lines") - F.size(F.array_distinct("_rule_lines"))).cast("long"),
    })
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    if table is None:
        rows = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        ratios = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
        total = F.aggregate(ngrams_of(F.col("_rule_w")), F.lit(0.0), lambda s, b: s + F.get(ratios, b))
        rows = rows.withColumn("score", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(True))
    return rows.withColumn("kept", kept).drop("_rule_w", "_rule_lines", "_rule_h", "_rule_placed", "_rule_part")


def kept_documents(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs.

    The partition number makes the verdict a column that the optimizer computes once, below the
    filter; it would otherwise write the verdict's whole expression into the filter, with the
    steps it is built from repeated for each element that they are used on.
    """
    whole = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_rule_row"))
    judged = judge(whole, trusted, threshold)
    return judged.withColumn("_rule_stays", F.col("kept") & (F.spark_partition_id() >= 0)).where("_rule_stays").select("_rule_row.*")
