"""Statistics of rare and of many suffixes count for the verdicts."""

import numpy as np
from pyspark.sql import functions as F

from wayframe.llm import url_trees

RULES = [("allow", "com/a"), ("block", "com/b")]


def pages_of(spark, dirs, each):
    """Only the first directory tells: other features are the same for both labels."""
    urls = [f"http://h.{t}/{'ab'[d % 2]}{d:05d}/{k}" for d in range(dirs) for t, n in (("com", each), ("net", 1)) for k in range(n)]
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_rare_suffixes(spark):
    """1,500 directories of 6 urls are none of them hot; they are joined by shuffles here."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = url_trees.judge_urls(pages_of(spark, 1500, 5), RULES).where("rule IS NULL").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 1500
    assert np.mean([(r.verdict == "block") == ("/b" in r.path) for r in rows]) > 0.95


def test_every_suffix_is_counted(spark):
    rows = pages_of(spark, 2500, 2).withColumns({"host": url_trees.host_of(F.col("url")), "path": url_trees.path_of(F.col("url"))})
    rows = rows.withColumn("_r", url_trees.rule_of(F.col("host"), F.col("path"), RULES))
    found = url_trees._suffixes(rows).where("key = '_dir'").collect()
    assert len(found) == 2500
    assert all((r.urls, sum(r.n), sum(r.b)) == (3, 2, 2 * (r.value[0] == "b")) for r in found)
