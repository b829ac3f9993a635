"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, each lane modulo 2**32. So order doesn't matter, and adding or taking a
paragraph is adding or taking its vector. A vector has LANES lanes, the eight words of the
paragraph's SHA-256, in which every paragraph counts in full (equality), and SKETCH lanes, read
as signed, in which it counts as +1 or -1 in a single lane that its MD5 names: their inner
products estimate how many paragraphs two documents share (likeness). No text has enough
paragraphs to wrap a signed lane.

A paragraph is a line; a line of several sentences counts as one for each. Only DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LANES, SKETCH = 8, 128
_LOW = (1 << 32) - 1
#: A document's place in the order: null ids last, and its text's hash after its id.
_KEY = ("none", "id", "h")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?]) "), lambda x: x != "")


def _number(digits: Column, at: Column | int, n: int) -> Column:
    """n hexadecimal digits from a place (from 0) as a long."""
    return F.conv(F.substr(digits, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(n)), 16, 10).cast("long")


def with_vector(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the column name: ``struct<full array<long>, sketch array<int>>`` of the column text."""
    units, wide, codes = (f"_{name}_{x}" for x in "uwc")
    rows = rows.withColumn(units, paragraphs(F.col(text)))
    rows = rows.withColumns({wide: F.transform(units, lambda u: F.sha2(u, 256)), codes: F.transform(units, lambda u: _number(F.md5(u), 0, 2).cast("int"))})  # 1 bit of sign, 7 of lane
    lane = lambda k: F.aggregate(wide, F.lit(0).cast("long"), lambda s, x: (s + _number(x, 8 * k, 8)).bitwiseAND(F.lit(_LOW)))
    full = F.array(*[lane(k) for k in range(LANES)])
    high = F.sequence(F.lit(0), F.lit(SKETCH // 16 - 1))
    low = F.sequence(F.lit(0), F.lit(15))
    inner = lambda sub: F.transform(low, lambda j: F.aggregate(sub, F.lit(0), lambda s, c: s + F.when(c.bitwiseAND(F.lit(15)) == j, F.lit(1) - F.shiftright(c, 7) * 2).otherwise(0)))
    sketch = F.flatten(F.transform(high, lambda i: F.transform(F.array(F.filter(codes, lambda c: F.shiftright(c, 4).bitwiseAND(F.lit(7)) == i)), inner)[0]))
    return rows.withColumn(name, F.struct(full.alias("full"), sketch.alias("sketch"))).drop(units, wide, codes)


def parsed(fingerprint: Column) -> Column:
    """The vector that a fingerprint's text stands for."""
    full, sketch = (F.element_at(F.split(fingerprint, "-"), k) for k in (1, 2))
    signed = lambda x: F.when(x > _LOW >> 1, x - (_LOW + 1)).otherwise(x).cast("int")
    each = lambda digits, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: _number(digits, k * 8, 8))
    return F.struct(each(full, LANES).alias("full"), F.transform(each(sketch, SKETCH), signed).alias("sketch"))


def _moved(a: str, b: str, sign: int) -> Column:
    """Vector a with vector b added (sign 1) or taken away (-1), lane by lane modulo 2**32."""
    full = F.zip_with(f"{a}.full", f"{b}.full", lambda x, y: (x + sign * y).bitwiseAND(F.lit(_LOW)))
    half = 1 << 31
    sketch = F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: ((x.cast("long") + sign * y + half).bitwiseAND(F.lit(_LOW)) - half).cast("int"))
    return F.struct(full.alias("full"), sketch.alias("sketch"))


def _changed(rows: DataFrame, text: str, fingerprint: str, sign: int) -> DataFrame:
    made = with_vector(rows.withColumn("_fp_old", parsed(F.col(fingerprint))), text, "_fp_by").withColumn("_fp_new", _moved("_fp_old", "_fp_by", sign))
    return made.withColumn(fingerprint, F.when(F.col(fingerprint).isNotNull(), fingerprint_text("_fp_new"))).select(rows.columns)


def insert(rows: DataFrame, text: str, fingerprint: str = "fingerprint") -> DataFrame:
    """rows with the paragraphs of the column text added to the fingerprint, without the document's other text. A null text has none; a null fingerprint stays null."""
    return _changed(rows, text, fingerprint, 1)


def delete(rows: DataFrame, text: str, fingerprint: str = "fingerprint") -> DataFrame:
    """rows with the paragraphs of the column text taken from the fingerprint; the opposite of insert."""
    return _changed(rows, text, fingerprint, -1)


def fingerprint_text(v: str) -> Column:
    """The vector in hexadecimal."""
    return F.concat(F.array_join(F.transform(f"{v}.full", lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit("-"), F.array_join(F.transform(f"{v}.sketch", lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(_LOW)))), 8, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the sketches (0 if negative or if one has no paragraphs)."""
    dot = lambda x, y: F.aggregate(F.zip_with(f"{x}.sketch", f"{y}.sketch", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = dot(a, a) * dot(b, b)
    cosine = F.when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / F.sqrt(norm)))).otherwise(0.0)
    return F.when((F.col(f"{a}.full") == F.col(f"{b}.full")) & (F.col(f"{a}.sketch") == F.col(f"{b}.sketch")), 1.0).otherwise(cosine)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of ``docs(doc_id, text, ...)``; a null text is an empty one, the sum of no paragraphs."""
    return with_vector(docs.select("doc_id", "text"), "text", "fp").select("doc_id", fingerprint_text("fp").alias("fingerprint"))


def _key() -> list[Column]:
    return [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h")]


def successors(docs: DataFrame) -> DataFrame:
    """``none, id, h, n, next_none, next_id, next_h`` for each different (doc_id, text): the next in descending doc_id, after the last the first.

    none: whether doc_id is null (id is then 0); h: the text's hash, by which equal ids are
    ordered. Only ids, hashes and lengths are sorted: by ranges, then within each range; the
    ends of ranges are joined over a table of one row a range.
    """
    slim = docs.select(*_key(), F.char_length(F.coalesce("text", F.lit(""))).alias("n")).distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("none").asc(), F.col("id").desc(), F.col("h").desc()]
    ranged = stored(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy(*order)
    ahead = ranged.withColumns({"ahead": F.lead(F.struct(*_KEY)).over(inside), "place": F.row_number().over(inside)})
    heads = ahead.where("place = 1").select("part", F.struct(*_KEY).alias("head"))
    over = Window.orderBy("part")  # a row for each range
    heads = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("then"))
    found = ahead.join(F.broadcast(heads), "part").withColumn("to", F.coalesce("ahead", "then"))  # a row for each range
    return found.select(*_KEY, "n", *[F.col(f"to.{k}").alias(f"next_{k}") for k in _KEY])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row of ``docs(doc_id, text, ...)``.

    The edited text has its last third (whole code points, rounded down) replaced by as many
    from the beginning of the next document in descending doc_id. Equal doc_ids are ordered by
    a hash of their texts and equal rows share a successor; null ids come last. A null text is
    an empty one. A table of one document is its own successor. Other columns are unused; an
    empty table gives no rows.
    """
    order = stored(successors(docs), "successors")
    # Both joins read the same columns of docs by the same keys, so the texts are dealt out once.
    keyed = docs.select(*_key(), "text")
    wanted = order.select(*[F.col(f"next_{k}").alias(k) for k in _KEY], F.struct(*_KEY).alias("by"), F.floor(F.col("n") / 3).cast("int").alias("m"))
    given = with_vector(keyed.join(wanted, list(_KEY)), "text", "next")
    given = given.groupBy(*[F.col(f"by.{k}").alias(k) for k in _KEY]).agg(F.first(F.struct("next", F.expr("substring(coalesce(text, ''), 1, m)").alias("begin"), "m")).alias("given"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keyed.join(given, list(_KEY)).select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), text.alias("text"), F.char_length(text).alias("n"), F.col("given.next").alias("next"), F.col("given.begin").alias("begin"), F.col("given.m").alias("m"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, n - m)"), "begin"))
    rows = with_vector(with_vector(rows, "text", "own"), "edited", "other")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint_text("own").alias("fingerprint"), fingerprint_text("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "next").alias("near_next"))
