"""Fingerprints of texts that repeat one line more often than a byte counts."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayframe.llm import multiset_hash


def test_repeated_lines(spark):
    counts = (1, 102, 128, 147, 150, 256, 300, 70_000)
    rows = spark.createDataFrame([(n, "of.\n" * n, "of.\n" * 100) for n in counts], "n int, a string, b string")
    rows = multiset_hash.with_vector(multiset_hash.with_vector(rows, "a", "x"), "b", "y")
    got = rows.select("n", "x.sketch", multiset_hash.likeness("x", "y").alias("near"), multiset_hash.fingerprint_text("x").alias("text")).collect()
    for r in got:
        lanes = [v for v in r.sketch if v]
        assert len(lanes) == 1 and abs(lanes[0]) == r.n  # a lane counts every repeat
        assert r.near == pytest.approx(1.0)
        hexadecimal = r.text.split("-")[1]
        assert np.array_equal(np.array([int(hexadecimal[k : k + 8], 16) for k in range(0, len(hexadecimal), 8)], "<u4").view("<i4"), r.sketch)


def test_edited_text_of_one_line(spark):
    docs = spark.createDataFrame([(2, "of.\n" * 150), (3, "of.\n" * 300), (1, "x" * 600)], "doc_id long, text string")
    got = {r.doc_id: r for r in multiset_hash.edited_likeness(docs).select("doc_id", F.round("near_edited", 6).alias("near_edited"), "near_next").collect()}
    assert got[3].near_next == pytest.approx(1.0) and got[3].near_edited == 1.0  # all 300 lines stay the same line
    assert 0.9 < got[2].near_edited < 1.0


def parts_of(text):
    return [p for line in (text or "").split("\n") for p in re.split("(?<=[.!?]) ", line) if p]


def vector(text):
    full, sketch = [0] * 8, [0] * 128
    for p in parts_of(text):
        wide, code = hashlib.sha256(p.encode()).digest(), hashlib.md5(p.encode()).digest()[0]
        full = [(x + int.from_bytes(wide[4 * k : 4 * k + 4])) % 2**32 for k, x in enumerate(full)]
        sketch[code & 127] += -1 if code >> 7 else 1
    return full, sketch


def text_of(v):
    return "".join(f"{x:08x}" for x in v[0]) + "-" + "".join(f"{x % 2**32:08x}" for x in v[1])


def near(a, b):
    if a == b:
        return 1.0
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    norm = dot(a[1], a[1]) * dot(b[1], b[1])
    return min(1.0, max(0.0, dot(a[1], b[1]) / math.sqrt(norm))) if norm else 0.0


def test_all_columns_against_plain_code(spark, odd):
    rng = random.Random(8)
    some = ["One. ", "Two!", " ", "\n", "\n\n", "drei? vier", "é", "...", "five six.  seven\r\n"]
    rows = [(k * 7 - 300, "".join(rng.choice(some) for _ in range(rng.randint(0, 40)))) for k in range(90)] + [(-(2**63), "least. id"), (None, "no id. at all"), (2**63 - 1, None)]
    ids = sorted((k for k, _ in rows if k is not None), reverse=True) + [None]
    after, text = dict(zip(ids, ids[1:] + ids[:1])), {k: t or "" for k, t in rows}
    got = {r.doc_id: r for r in multiset_hash.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(ids) and len(got) == len(rows)
    for k, r in got.items():
        n, following = len(text[k]), text[after[k]]
        edited = text[k][: n - n // 3] + following[: n // 3]
        own, other, ahead = vector(text[k]), vector(edited), vector(following)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, hashlib.sha256(edited.encode()).hexdigest(), text_of(own), text_of(other))
        assert (r.near_edited, r.near_next) == (near(own, other), near(own, ahead))


def test_insertion_and_deletion(spark):
    rows = [("One. Two.\nThree", "Four.\nOne."), ("", "x"), ("a. a. a.", "a."), ("a", None), (None, "b!")]
    df = multiset_hash.with_vector(spark.createDataFrame(rows, "text string, more string"), "text", "v")
    df = df.select("text", "more", multiset_hash.fingerprint_text("v").alias("fingerprint"))
    added = multiset_hash.insert(df, "more")
    assert added.columns == df.columns
    for r in added.collect():
        assert r.fingerprint == text_of(vector((r.text or "") + "\n" + (r.more or "")))
    assert sorted(multiset_hash.delete(added, "more").collect(), key=repr) == sorted(df.collect(), key=repr)
    assert multiset_hash.delete(df, "more").where("fingerprint IS NULL").count() == 0  # below zero lanes wrap
    none = df.withColumn("fingerprint", F.lit(None).cast("string"))
    assert multiset_hash.insert(none, "more").where("fingerprint IS NOT NULL").count() == 0
