"""URL filter: rules of hosts and paths, and gradient-boosted trees for what no rule decides.

URLs that a rule fits are labelled by it; on these the trees learn from lexical features of the
url (length, depth, digit share, entropy, parameters, host parts) and from statistics of host
suffixes (how often labelled urls with this suffix were blocked). Other urls get the trees'
verdict. Only DataFrame functions and MLlib's trees, which run in the JVM.

Statistics are a table of all suffixes, smoothed by the share of blocked urls. The urls that
are learned from see those of the other folds, else a rare suffix would tell its own label.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Labelled urls that are learned from at most, least by a hash of the url; trees and their depth.
MOST_ROWS, TREES, DEPTH = 20_000, 10, 4
#: Kinds of suffixes: last host part, last two, first directory, file ending. Folds of labelled urls.
KEYS, FOLDS = ("_top", "_two", "_dir", "_end"), 5
#: A suffix with a 1/HOT of all urls is hot (so at most HOT of a kind) and broadcast; SALTS deal the urls that have it.
HOT, SALTS = 1_000, 4_096


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null. rules: (verdict, host/path)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest comes last and so goes first
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _features(rows: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda c, pattern: F.size(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))).cast("double")
    n = F.char_length(url)
    symbols = F.filter(F.split(url, ""), lambda c: c != "")
    kinds = F.array_distinct(symbols)
    share = lambda c: (n - F.char_length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(kinds, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    parts = F.split("host", r"\.")
    return rows.withColumns({
        "f_length": n.cast("double"), "f_host_length": F.char_length("host").cast("double"), "f_path_length": F.char_length("path").cast("double"),
        "f_host_parts": F.size(parts).cast("double"), "f_depth": count(F.col("path"), "/[^/]"), "f_digits": F.when(n > 0, count(url, "[0-9]") / n).otherwise(0.0),
        "f_entropy": F.when(n > 0, entropy).otherwise(0.0), "f_parameters": count(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "[^&]+"),
        "f_secure": url.startswith("https:").cast("double"), "f_fragment": url.contains("#").cast("double"), "f_slash_end": F.col("path").endswith("/").cast("double"),
        "f_hyphens": count(url, "[-_%]"), "f_part": F.char_length(F.regexp_extract("path", r"^/([^/]*)", 1)).cast("double"),
    })


def _suffix(key: str) -> Column:
    return {"_top": F.element_at(F.split("host", r"\."), -1), "_two": F.substring_index("host", ".", -2), "_dir": F.regexp_extract("path", r"^/([^/]*)/", 1), "_end": F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)}[key]


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def _suffixes(rows: DataFrame) -> DataFrame:
    """``key, value, urls, n array<long>, b array<long>`` of every suffix: all urls, and by fold the labelled and the blocked ones."""
    each = rows.select(_fold().alias("fold"), F.col("_r.verdict").alias("verdict"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), _suffix(k).alias("value")) for k in KEYS])).alias("s"))
    labelled = lambda k: F.col("verdict").isNotNull() & (F.col("fold") == k)
    n = F.array(*[F.count_if(labelled(k)) for k in range(FOLDS)])
    b = F.array(*[F.count_if(labelled(k) & (F.col("verdict") == "block")) for k in range(FOLDS)])
    return each.groupBy("s.key", "s.value").agg(F.count("*").alias("urls"), n.alias("n"), b.alias("b"))


def _with_statistics(rows: DataFrame, suffixes: DataFrame, total: int, prior: float, own: bool) -> DataFrame:
    """Adds ``f_top, f_two, f_dir, f_end``: log odds of blocking, smoothed by the prior; without the url's own fold unless own.

    Hot suffixes are joined by broadcast, and their urls dealt by a hash instead of the suffix.
    """
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    hot = F.col("urls") * HOT >= total
    for key in KEYS:
        one = suffixes.where(F.col("key") == key)
        rows = rows.withColumn("_s", _suffix(key)).join(F.broadcast(one.where(hot).select(F.col("value").alias("_s"), F.struct("n", "b").alias("_hot"))), "_s", "left")  # HOT rows at most
        dealt = F.when(F.col("_hot").isNull(), F.concat(F.lit("="), "_s")).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("string")))
        rest = one.where(~hot & (add(F.col("n")) > 0)).select(F.concat(F.lit("="), "value").alias("_s"), F.struct("n", "b").alias("_rest"))
        rows = rows.withColumn("_s", dealt).join(rest, "_s", "left").withColumn("_f", F.coalesce("_hot", "_rest"))
        n, b = (F.coalesce(add(F.col(f"_f.{c}")) - (0 if own else F.get(F.col(f"_f.{c}"), _fold())), F.lit(0)) for c in "nb")
        rows = rows.withColumn(f"f{key}", F.log((b + prior) / (n - b + (1 - prior)))).drop("_s", "_hot", "_rest", "_f")
    return rows


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], most_rows: int = MOST_ROWS, block_from: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row of ``pages(page_id, url, ...)``.

    verdict is the rule's or, where none fits, ``block`` if the trees' score (probability of
    blocking) reaches block_from. score is null where a rule decides. A null url, or one without
    ``://``, has an empty host and path and is judged by the trees. If the rules don't give both
    verdicts there is nothing to learn, and urls without a rule get the verdict that labelled
    urls have (allow if none). Repeated rows are judged each; other columns are unused; an empty
    table gives no rows.
    """
    rows = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    labelled = rows.where("_r IS NOT NULL")
    totals = {r.verdict: r.n for r in labelled.groupBy(F.col("_r.verdict").alias("verdict")).agg(F.count("*").alias("n")).collect()}
    answer = ["page_id", "host", "path", F.col("_r.rule").alias("rule")]
    if len(totals) < 2:
        return rows.select(*answer, F.coalesce("_r.verdict", F.lit(next(iter(totals), "allow"))).alias("verdict"), F.lit(None).cast("double").alias("score"))
    prior = totals["block"] / (totals["block"] + totals["allow"])

    suffixes = stored(_suffixes(rows), "url-suffixes")
    total = suffixes.where(F.col("key") == KEYS[0]).agg(F.sum("urls").alias("n")).first().n
    chosen = labelled.withColumn("_k", F.xxhash64("url")).orderBy("_k").limit(most_rows).select("url", "host", "path", (F.col("_r.verdict") == "block").cast("double").alias("label"))
    chosen = _features(_with_statistics(stored(chosen, "url-choice"), suffixes, total, prior, own=False))
    inputs = sorted(c for c in chosen.columns if c.startswith("f_"))
    chosen = chosen.select(*inputs, "label", "url").orderBy("url").drop("url")
    chosen = stored(chosen, "url-training").repartition(8)
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=5, cacheNodeIds=False)
    model = trees.fit(assembler.transform(chosen).select("features", "label"))
    features = _features(_with_statistics(rows, suffixes, total, prior, own=True))
    scored = model.transform(assembler.transform(features)).withColumn("_p", vector_to_array("probability")[1])
    method = F.when(F.col("_p") >= block_from, "block").otherwise("allow")
    return scored.select(*answer, F.coalesce("_r.verdict", method).alias("verdict"), F.when(F.col("_r").isNull(), F.col("_p")).alias("score"))
