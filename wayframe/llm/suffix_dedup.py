"""Removal of repeated byte strings: every byte of a LENGTH-byte string that starts elsewhere too.

1. Anchors. Each window of LENGTH bytes is given the leftmost GRAM-byte string in it with the
   least hash. Windows with one anchor are consecutive; the bytes under them are a *stretch*.
   Equal windows have equal anchors, so a window can only be repeated within its anchor's group,
   and there only at the same distance from the anchor. Stretches that follow one another and
   are equal, as in periodic text, are one row with a count.
2. Stretches of equal bytes are one *kind*. Groups of one kind are repeated throughout or not at
   all; that is their count.
3. The kinds of other groups are fetched and gathered by group. Tasks build Burrows-Wheeler
   transforms of shards of them and merge these (see bwt.py); common prefixes of LENGTH bytes or
   more give the repeated places.
4. A group of more than CROWD kinds is divided first: its kinds are cut into cells of windows at
   the same distances from the anchor, and grouped by the bytes that all windows of a cell
   share. Cells get narrower (WIDTHS) until a group has CROWD kinds or fewer and is merged. A
   cell of one window is grouped by all its bytes, so each group ends, however large it was.
5. Repeated places become byte spans of every document with that stretch, and are cut out.

Kinds are told apart by 128-bit hashes (xxh3): among 10**12 of them two differ in bytes and not
in hash with a probability under 10**-14. Inside merges bytes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bwt import prefix_sums, repeated, run_hashes
from .common import discard, nested, recounted, shared_dir, steps, stored

LENGTH, GRAM, CROWD = 200, 40, 2048
#: Windows in the cells of crowded groups, level by level; the last is one.
WIDTHS = (41, 11, 3, 1)
#: Bytes of stretches that one merge takes, if it holds several groups.
MERGE_BYTES = 1 << 20
_NO_ID = -(1 << 63)
_HASH_SEED = 0x5EED


def _keys() -> list[Column]:
    """A document's identity: its doc_id (least long for null) and its text's hash."""
    return [F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("h")]


def _kinds(data: bytes, starts: list[int], ends: list[int], seeds: list[int] | None = None) -> np.ndarray:
    """128-bit hashes of data[start:end] as rows of two longs; seeds: what else is told apart."""
    digest = xxhash.xxh3_128_digest
    if seeds is None:
        hashed = [digest(data[a:b], _HASH_SEED) for a, b in zip(starts, ends)]
    else:
        hashed = [digest(data[a:b], _HASH_SEED + (k + 256 << 16)) for a, b, k in zip(starts, ends, seeds)]
    return np.frombuffer(b"".join(hashed), np.int64).reshape(-1, 2)


def stretches(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``text, start, windows, anchor_at, times, anchor, c1, c2`` of all stretches of texts (arrays; anchor_at from the start, anchor and content as hashes; times: so many equal stretches in a row)."""
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    joined = b"".join(parts)
    data = np.frombuffer(joined, np.uint8)
    n, width = len(data), LENGTH - GRAM + 1
    mark = np.zeros(n + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(mark, begins[:-1][long], 1)
    np.add.at(mark, begins[:-1][long] + sizes[long] - LENGTH + 1, -1)
    valid = np.flatnonzero(np.cumsum(mark)[: max(0, n - LENGTH + 1)] > 0)
    if not len(valid):
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int32, np.int32, np.int64, np.int64, np.int64))
    sums, inverse = prefix_sums(data)
    grams = np.arange(n - GRAM + 1)
    hashes = run_hashes(sums, inverse, grams, grams + GRAM)
    # 32 bits of the hash, then the place, so the leftmost of equal ones. Runs of one byte come last: they would be anchors of one window each.
    order = np.minimum(hashes >> np.uint64(32), np.uint64((1 << 32) - 2))
    same = np.concatenate([[0], np.cumsum(data[1:] == data[:-1], dtype=np.int32)])
    order[same[GRAM - 1 :] - same[: n - GRAM + 1] == GRAM - 1] = np.uint64((1 << 32) - 1)
    least, reach = (order << np.uint64(32)) | grams.astype(np.uint64), 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = (least[valid] & np.uint64((1 << 32) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    start, windows = valid[first], np.diff(np.concatenate([first, [len(valid)]]))
    place = place[first]
    text = np.searchsorted(begins, start, side="right") - 1
    # Equal stretches in a row have one anchor, at one distance, and as many windows each; their bytes decide.
    again = np.concatenate([[False], (hashes[place[1:]] == hashes[place[:-1]]) & (windows[1:] == windows[:-1]) & (start[1:] == start[:-1] + windows[:-1]) & (text[1:] == text[:-1])])
    for k in np.flatnonzero(again).tolist():
        a, b = int(start[k]), int(start[k] + windows[k]) + LENGTH - 1
        again[k] = joined[a:b] == joined[a - int(windows[k]) : b - int(windows[k])]
    once = np.flatnonzero(~again)
    times = np.diff(np.append(once, len(start)))
    text, start, windows, place = text[once], start[once], windows[once], place[once]
    content = _kinds(joined, start.tolist(), (start + windows + LENGTH - 1).tolist())
    return text, (start - begins[text]).astype(np.int32), windows.astype(np.int32), (place - start).astype(np.int32), times.astype(np.int32), hashes[place].view(np.int64), content[:, 0], content[:, 1]


def _compressed(rows: DataFrame, name: str) -> DataFrame:
    """rows with the text (last column) as zstandard frames, the column name: for exchanges of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        for batch in steps(batches):
            frames = [None if t is None else pack(t) for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(frames, pa.binary())], [*batch.schema.names[:-1], name])

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema[:-1]), T.StructField(name, T.BinaryType())])
    return rows.mapInArrow(run, schema)


def _expanded(frames: pa.Array) -> list[bytes | None]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [None if f is None else unpack(f) for f in frames.to_pylist()]


_STRETCH = "id long, h long, start int, windows int, anchor_at int, times int, anchor long, c1 long, c2 long"


def _all_stretches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            text, *rest = stretches([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[text], hs[text], *rest)], [c.split()[0] for c in _STRETCH.split(", ")])

    return docs.where("text IS NOT NULL").select(*_keys(), "text").mapInArrow(run, _STRETCH)


def _fetched(kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of each kind, from the document that ``at`` names: ``g1, g2, k1, k2, copies, crowded, place, bytes``. Equal rows of docs give equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            wanted, data = batch.column(0), _expanded(batch.column(1))
            flat, owner = wanted.flatten(), np.repeat(np.arange(len(wanted)), pa.compute.list_value_length(wanted).to_numpy())
            columns = {k: flat.field(k) for k in ("g1", "g2", "k1", "k2", "copies", "crowded", "place")}
            cut = [data[i][s : s + w + LENGTH - 1] for i, s, w in zip(owner.tolist(), flat.field("start").to_pylist(), flat.field("windows").to_pylist())]
            yield pa.RecordBatch.from_pydict(columns | {"bytes": pa.array(cut, pa.binary())})

    one = F.struct(F.col("anchor").alias("g1"), F.lit(0).cast("long").alias("g2"), F.col("c1").alias("k1"), F.col("c2").alias("k2"), "copies", "crowded", (-F.col("at.anchor_at")).alias("place"), "at.start", "at.windows")
    wanted = kinds.select("at.id", "at.h", one.alias("w")).groupBy("id", "h").agg(F.collect_list("w").alias("wanted"))
    texts = _compressed(docs.where("text IS NOT NULL").select(*_keys(), "text"), "frame").join(wanted.hint("shuffle_hash"), ["id", "h"])
    return texts.select("wanted", "frame").mapInArrow(run, "g1 long, g2 long, k1 long, k2 long, copies long, crowded boolean, place int, bytes binary")


_FOUND = "k1 long, k2 long, a int, b int"


def _merged(rows: DataFrame) -> DataFrame:
    """Repeated ranges of windows of kinds: rows ``g1, g2, k1, k2, bytes`` to _FOUND; whole groups are merged together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple[int, int], tuple[int, int], bytes]] = []
        size = 0

        def out() -> pa.RecordBatch:
            made: list[list] = [[], [], [], []]
            for (_, k, _), hit in zip(held, repeated([x for *_, x in held], LENGTH)):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                for c, v in zip(made, ([k[0]] * (len(edge) // 2), [k[1]] * (len(edge) // 2), edge[::2].tolist(), edge[1::2].tolist())):
                    c += v
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(made, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["k1", "k2", "a", "b"])

        for batch in batches:
            g1, g2, k1, k2, data = (batch.column(k).to_pylist() for k in ("g1", "g2", "k1", "k2", "bytes"))
            for g, k, x in zip(zip(g1, g2), zip(k1, k2), data):
                if held and held[-1][1] == k:
                    continue  # an equal row of docs
                if size >= MERGE_BYTES and g != held[-1][0]:
                    yield out()
                    held, size = [], 0
                held.append((g, k, x))
                size += len(x)
        if held:
            yield out()

    keys = ("g1", "g2", "k1", "k2")
    return rows.select(*keys, "bytes").repartition("g1", "g2").sortWithinPartitions(*keys).mapInArrow(run, _FOUND)


_CELL = "o1 long, o2 long, a0 int, g1 long, g2 long, k1 long, k2 long, copies long, place int, bytes binary"


def _divided(rows: DataFrame, level: int = 0) -> DataFrame:
    """Repeated ranges (_FOUND) of the kinds of crowded groups, ``k1, k2, copies, place, bytes``: by cells of WIDTHS[level] windows, and narrower ones where those are crowded."""
    width = WIDTHS[level]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in _CELL.split(", ")}
            for k1, k2, n, at, x in zip(*(batch.column(k).to_pylist() for k in ("k1", "k2", "copies", "place", "bytes"))):
                windows = len(x) - LENGTH + 1
                for cell in range(at // width, (at + windows - 1) // width + 1):
                    lo, hi = cell * width - at, (cell + 1) * width - at
                    a, b = max(lo, 0), min(hi, windows)
                    (g, k) = _kinds(x, [hi - 1, a], [lo + LENGTH, b + LENGTH - 1], [cell, a + at]).tolist()
                    for c, v in zip(out.values(), (k1, k2, a, *g, *k, n, a + at, x[a : b + LENGTH - 1])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for v, c in zip(out.values(), _CELL.split(", "))], list(out))

    paths = [shared_dir(rows.sparkSession, x) for x in ("cells", "kinds")]
    cut = stored(rows.mapInArrow(cells, _CELL), "cells", paths[0])
    kinds = cut.groupBy("g1", "g2", "k1", "k2").agg(F.sum("copies").alias("copies"), F.min(F.struct("place", "bytes")).alias("one"))
    kinds = stored(kinds.select("g1", "g2", "k1", "k2", "copies", "one.place", "one.bytes"), "kinds", paths[1])
    sizes = kinds.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1")
    rest = kinds.join(sizes, ["g1", "g2"])
    found = kinds.where("copies > 1").select("k1", "k2", F.lit(0).alias("a"), (F.length("bytes") - (LENGTH - 1)).alias("b")).unionByName(_merged(rest.where(F.col("n") <= CROWD)))
    crowded = rest.where(F.col("n") > CROWD)
    if level + 1 < len(WIDTHS) and not crowded.isEmpty():
        found = found.unionByName(_divided(crowded, level + 1))
    owners = cut.select("o1", "o2", "a0", "k1", "k2")
    out = stored(owners.join(found, ["k1", "k2"]).select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), (F.col("a0") + F.col("a")).alias("a"), (F.col("a0") + F.col("b")).alias("b")), "found")
    for path in paths:
        discard(rows, path)
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``id, h, spans array<struct<a, b>>``: byte spans to remove from each document (see _keys); spans may overlap."""
    spark = docs.sparkSession
    at = [shared_dir(spark, x) for x in ("stretches", "shared", "kinds", "bytes", "groups", "crowds")]
    parts = stored(_all_stretches(docs), "stretches", at[0])
    ends = [f("c" + k).alias(f"{name}{k}") for k in "12" for name, f in (("low", F.min), ("high", F.max))]
    groups = parts.groupBy("anchor").agg(F.sum("times").alias("n"), *ends).where("n > 1").select("anchor", F.expr("low1 = high1 AND low2 = high2").alias("alike"))
    # Written first, so that the join reads both sides by plain exchanges, of which a hot anchor's can be split.
    shared = stored(parts.join(stored(groups, "groups", at[4]), "anchor"), "shared", at[1])
    discard(parts, at[0])
    unlike = shared.where("NOT alike")
    kinds = unlike.groupBy("anchor", "c1", "c2").agg(F.sum("times").alias("copies"), F.min(F.struct("id", "h", "start", "windows", "anchor_at")).alias("at"))
    kinds = stored(kinds, "kinds", at[2])
    crowds = stored(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("anchor", F.lit(True).alias("crowded")), "crowds", at[5])
    marked = kinds.join(crowds, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    bytes_of = stored(_fetched(marked, docs), "bytes", at[3])
    crowded = bytes_of.where("crowded").dropDuplicates(["k1", "k2"])
    found = _merged(bytes_of.where("NOT crowded"))
    if not bytes_of.where("crowded").isEmpty():
        found = found.unionByName(_divided(crowded))
    copied = kinds.where("copies > 1").select("c1", "c2", F.lit(0).alias("a"), F.col("at.windows").alias("b"))
    ranges = found.withColumnsRenamed({"k1": "c1", "k2": "c2"}).unionByName(copied)
    placed = unlike.where("times = 1").join(ranges, ["c1", "c2"]).select("id", "h", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + LENGTH - 1).alias("b")).alias("span"))
    whole = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows") * F.col("times") + LENGTH - 1).alias("b"))
    spans = shared.where("alike OR times > 1").select("id", "h", whole.alias("span")).unionByName(placed)
    out = stored(spans.groupBy("id", "h").agg(F.collect_list("span").alias("spans")), "spans")
    for path in at[1:]:
        discard(docs, path)
    return out


def joined_runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping or adjoining spans as maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for run in runs for x in run), len(data)]
    return b"".join([data[a:b] for a, b in zip(ends[::2], ends[1::2])])


def _with_spans(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``spans, <first column of rows>, frame``; rows: a column to keep, doc_id and text of docs."""
    kept = rows.columns[0]
    keyed = _compressed(rows.select(*_keys(), F.col(kept).alias("kept"), "text"), "frame")
    return keyed.join(repeated_spans(docs).hint("shuffle_hash"), ["id", "h"], "left").select("spans", F.col("kept").alias(kept), "frame")


def removal_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs(doc_id, text, ...)``.

    Texts are UTF-8 bytes, null is empty. Repeated rows repeat each other's strings. Texts under
    LENGTH bytes stay whole. A null doc_id stays null; other columns are unused; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = []
            for doc_id, spans, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _expanded(batch.column(2))):
                data, runs = data or b"", joined_runs(spans)
                rows.append((doc_id, len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(F.col("doc_id").alias("own_id"), "doc_id", "text")
    return _with_spans(rows, docs).select("own_id", "spans", "frame").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs with repeated strings cut out of text, and n_chars (where there is such a column) counted anew for changed texts. Characters that a cut divides go as a whole; a null text stays null."""
    rows = _with_spans(nested(docs), docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = []
            for spans, data in zip(batch.column(0).to_pylist(), _expanded(batch.column(2))):
                runs = [] if data is None else joined_runs(spans)
                ends = [0, *(x for r in runs for x in r), len(data or b"")]
                texts.append(None if data is None else "".join([data[a:b].decode("utf-8", "ignore") for a, b in zip(ends[::2], ends[1::2])]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string()), pa.compute.is_valid(batch.column(0))], ["row", "text", "changed"])

    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])
    return recounted(rows.mapInArrow(run, schema), docs, "changed")
