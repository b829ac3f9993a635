"""Near-duplicate join: a MinHash LSH forest, then exact Jaccard similarity of word shingles.

1. Each text gets its set of shingle hashes; equal sets form one class, and one signature stands
   for the class.
2. A signature is TREES labels of DEPTH symbols, each symbol a minimum hash. Each tree is a trie
   of the classes' labels, kept as sorted labels: neighbours' common prefixes give its nodes.
3. A group of classes starts as those with a whole label in common. Its prefix is shortened
   symbol by symbol, which lets it meet the groups beside it, until the estimated recall of its
   links (from the similarity that signatures show) reaches the target. A class that has met
   nobody is taken to have a partner at the threshold, so it goes down to the length at which
   such a pair meets with the target probability; no prefix needs to be shorter than that.
4. Meeting classes whose signatures don't rule them out form neighbourhoods (connected
   components), which are cut into blocks; each pair of blocks is a task of bounded size that
   computes exact similarities as a product of sparse 0/1 matrices. Links are counted there and
   only a spanning forest of them leaves the task.
5. Components of the verified links are the groups.

A trie node of more than CROWD classes is cut into blocks too, and pairs of blocks are compared
one by one, so no node is gathered whole and no pair of a node is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, nested, shared_dir, steps, stored, unnested
from .components import connected_components
from .shingles import mixed, shingle_sets

TREES, DEPTH, CROWD, BLOCK = 24, 6, 1024, 192
#: A pair is ruled out if its signatures agree so many standard deviations less often than at the threshold.
SIGMAS = 5.0
#: Standard deviations by which a similarity that signatures show is lowered before recall is estimated from it.
CAUTION = 2.0


def meeting_chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair has the first depth symbols in common in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortest_prefix(threshold: float, target: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The length at which a pair at the threshold meets with the target probability (1 at least)."""
    while depth > 1 and meeting_chance(threshold, depth, trees) < target:
        depth -= 1
    return depth


def _constants(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64)).astype(np.uint32)
    return x[::2, None] | np.uint32(1), x[1::2, None]


def signature(shingles: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the shingles."""
    h, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(factor), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(h), 256):
            x = (h[None, k : k + 256] ^ shift) * factor
            x ^= x >> np.uint32(15)
            np.minimum(out, x.min(axis=1), out=out)
    return out


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_hash, set_key, labels``: a class key and the TREES labels end to end, symbols of two bytes. Texts without a word have null keys."""
    factor, shift = _constants(TREES, DEPTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            keys, labels = [], []
            for s in shingle_sets(batch.column(1), words):
                if not len(s):
                    keys.append(None), labels.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                labels.append((signature(s, factor, shift) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(labels, pa.binary())], ["doc_id", "text_hash", "set_key", "labels"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, set_key binary, labels binary")


class _Union:
    """Union-find over 0 .. n - 1 by smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole runs of rows with equal first columns (that many) from sorted batches; each table holds runs of about 8192 rows together. A run is bounded by the caller."""
    held: list[pa.RecordBatch] = []

    def marks(t: pa.Table) -> np.ndarray:
        n = t.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for c in range(keys):
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return new

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 8192:
            continue
        t = pa.Table.from_batches(held)
        last = int(np.flatnonzero(marks(t))[-1])
        if last:
            yield t.slice(0, last)
        held, size = t.slice(last).to_batches(), t.num_rows - last
    if size:
        yield pa.Table.from_batches(held)


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    """Where runs start, with the end as a last entry."""
    new = np.zeros(t.num_rows + 1, bool)
    new[[0, -1]] = True
    for c in range(keys):
        v = t.column(c).to_numpy()
        new[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


class Forest:
    """What a trie node's classes have to do with each other; threshold and target as in near_duplicates."""

    def __init__(self, threshold: float, target: float):
        self.threshold, self.target = threshold, target
        self.shortest = shortest_prefix(threshold, target)
        self.spread = float(np.sqrt(threshold * (1 - threshold) / (TREES * DEPTH)))
        self.least = threshold - SIGMAS * self.spread

    def enough(self, shown: float, depth: int) -> bool:
        """Whether links as weak as shown are found at this depth with the target probability."""
        return meeting_chance(min(1.0, max(self.threshold, shown - CAUTION * self.spread)), depth) >= self.target

    def grouped(self, labels: np.ndarray, signatures: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
        """For sorted labels (a row of symbols each) the group of each class, as the place of its first.

        side: only classes of different sides are compared. From whole labels down to the
        shortest prefix: runs with a common prefix of that length are groups; a run compares
        classes of different runs before it, save two runs that have reached the target.
        """
        n = len(labels)
        group, done, weakest = np.arange(n), np.zeros(n, bool), np.ones(n)
        common = np.concatenate([[0], (labels[1:] == labels[:-1]).cumprod(axis=1).sum(axis=1)])  # symbols shared with the class before
        before = np.arange(n)  # the run of one symbol more
        for depth in range(DEPTH, self.shortest - 1, -1):
            at = np.append(np.flatnonzero(common < depth), n)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a < 2:
                    continue
                for i in range(a, b - 1):
                    rest = np.arange(i + 1, b)
                    # Equal groups need no further link; runs that have reached the target need none between them.
                    rest = rest[(group[rest] != group[i]) & (before[rest] != before[i]) & ~(done[i] & done[rest])]
                    if side is not None:
                        rest = rest[side[rest] != side[i]]
                    if not len(rest):
                        continue
                    shown = (signatures[rest] == signatures[i]).mean(axis=1)
                    for j, s in zip(rest[shown >= self.least].tolist(), shown[shown >= self.least].tolist()):
                        low, high = sorted((group[i], group[j]))
                        if low != high:
                            group[a:b][group[a:b] == high] = low
                            weakest[i] = min(weakest[i], s)
                before[a:b], weakest[a:b] = a, weakest[a:b].min()
                done[a:b] = (group[a:b] == group[a]).all() and self.enough(weakest[a], depth)
        return group


def _meetings(classes: DataFrame, forest: Forest) -> DataFrame:
    """Edges ``a, b`` between classes that meet in a trie and whose signatures don't rule them out: from each class to the least of its group there."""
    width, end = 2 * DEPTH, 2 * forest.shortest

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            low, high, block = (t.column(k).to_numpy() for k in (1, 2, 3))
            keys = t.column(4).to_pylist()
            label = np.frombuffer(b"".join(t.column(5).to_pylist()), ">u2").reshape(-1, DEPTH)
            signatures = np.frombuffer(b"".join(t.column(6).to_pylist()), ">u2").reshape(-1, TREES * DEPTH)
            at, out = _starts(t, 3), set()
            two = at[:-1][np.diff(at) == 2]  # most nodes: one pair, which meets at the node whatever more it has in common
            shown = (signatures[two] == signatures[two + 1]).mean(axis=1)
            out.update(tuple(sorted(keys[i : i + 2])) for i in two[(shown >= forest.least) & ((low == high)[two] | (block[two] != block[two + 1]))].tolist())
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a < 3:
                    continue
                group = forest.grouped(label[a:b], signatures[a:b], block[a:b] if low[a] != high[a] else None)
                of: dict[int, list[bytes]] = {}
                for g, k in zip(group.tolist(), keys[a:b]):
                    of.setdefault(g, []).append(k)
                for members in of.values():
                    first = min(members)
                    out.update((first, k) for k in members if k != first)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in zip(*out)], ["a", "b"])

    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    nodes = classes.select("set_key", "labels", tree).select("set_key", "tree", F.xxhash64("tree", F.expr(f"substring(labels, tree * {width} + 1, {end})")).alias("node"))
    shared = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.ceil(F.col("n") / CROWD).cast("int").alias("blocks"))
    met = nodes.join(shared, "node").groupBy("set_key").agg(F.collect_list(F.struct("node", "tree", "blocks")).alias("nodes"))  # TREES at most
    rows = met.join(classes.select("set_key", "labels"), "set_key").select("set_key", "labels", F.explode("nodes").alias("v"))
    block = F.pmod(F.xxhash64("set_key"), F.col("v.blocks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("v.blocks") - 1)).alias("other")
    rows = rows.select("v.node", block.alias("block"), "set_key", F.expr(f"substring(labels, v.tree * {width} + 1, {width})").alias("label"), "labels", other)
    tiles = rows.select("node", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "set_key", "label", "labels")
    dealt = tiles.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high", "label", "set_key")
    return dealt.mapInArrow(compare, "a binary, b binary")


def _verified(members: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """Exact links in blocks: rows ``a, b`` (a spanning forest of a task's links) and ``a, links, texts`` (counts)."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):  # text comes last
            sets = shingle_sets(batch.column("text"), words)
            keep = [i for i, s in enumerate(sets) if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == batch.column("set_key")[i].as_py()]
            t = pa.Table.from_batches([batch]).take(keep).drop_columns(["text"])
            yield from t.append_column("shingles", pa.array([sets[i].tobytes() for i in keep], pa.binary())).combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            at, out = _starts(t, 3), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                out += _tile(t.slice(a, b - a), threshold)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["a", "b", "links", "texts"])

    texts = docs.select("doc_id", "text").join(members, F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.xxhash64("text") == F.col("rep.text_hash")))
    sets = texts.select("label", "blocks", "block", "set_key", "copies", "text").mapInArrow(shingled, "label binary, blocks int, block int, set_key binary, copies long, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = sets.select("*", other).select("label", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "set_key", "copies", "shingles")
    return tiles.repartition("label", "low", "high").sortWithinPartitions("label", "low", "high", "set_key").mapInArrow(compare, "a binary, b binary, links long, texts long")


def _tile(t: pa.Table, threshold: float) -> list[tuple]:
    """Links between the blocks low and high (or within one): counts for each class, edges of a spanning forest."""
    low, high = t.column(1)[0].as_py(), t.column(2)[0].as_py()
    keys = t.column(4).to_pylist()
    first = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]  # equal rows of one class
    keys, block, copies = [keys[i] for i in first], t.column(3).to_numpy()[first], t.column(5).to_numpy()[first]
    raw = t.column(6).to_pylist()
    sets = [np.frombuffer(raw[i], np.uint64) for i in first]
    n = len(keys)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.float64)
    ids, number = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    often = np.bincount(number)[number] > 1
    row, number = row[often], number[often]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    common = np.zeros((n, n), np.float32)
    for k in range(0, len(ids), 4096):
        a, b = np.searchsorted(number, [k, k + 4096])
        if a < b:
            used, column = np.unique(number[a:b], return_inverse=True)
            m = np.zeros((n, len(used)), np.float32)
            m[row[a:b], column] = 1
            common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    if low != high:
        linked &= block[:, None] != block[None, :]
    out = [(keys[i], None, int(x), int(y)) for i, (x, y) in enumerate(zip(linked @ copies, linked.sum(axis=1))) if y]
    group = _Union(n)
    for i in range(n):
        for j in np.flatnonzero(linked[i, i + 1 :]).tolist():
            if group.join(i, i + 1 + j):
                out.append((keys[i], keys[i + 1 + j], 0, 0))
    return out


def _grouped(docs: DataFrame, words: int, threshold: float, target: float) -> tuple[DataFrame, list[str]]:
    """For each row ``doc_id, text_hash, set_key, class_id, one, n_links, n_texts``; one: the document that stands for the group. And the tables to delete once that is read."""
    at = [shared_dir(docs.sparkSession, x) for x in ("signatures", "classes", "links")]
    signed = stored(_signed(docs, words), "signatures", at[0])
    classes = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("rep"), F.first("labels").alias("labels"))
    classes = stored(classes, "classes", at[1])
    near = connected_components(_meetings(classes, Forest(threshold, target)))
    sizes = near.groupBy("label").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    spread = F.pmod(F.xxhash64("set_key"), F.col("blocks").cast("long")).cast("int")
    members = near.withColumnRenamed("node", "set_key").join(sizes.select("label", "blocks"), "label").join(classes.select("set_key", "copies", "rep"), "set_key").select("set_key", "label", "blocks", spread.alias("block"), "copies", "rep")
    found = stored(_verified(members, docs, words, threshold), "links", at[2])
    groups = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("set_key")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    placed = classes.select("set_key", "copies", "rep").join(groups.withColumnRenamed("node", "set_key"), "set_key", "left").join(counts, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    ids = placed.groupBy("label").agg(F.min("rep.doc_id").alias("class_id"), F.min("rep").alias("one"))
    info = placed.join(ids, "label").select("set_key", "class_id", "one", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"))
    return signed.select("doc_id", "text_hash", "set_key").join(info, "set_key", "left"), at


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, target: float = 0.9999) -> DataFrame:
    """``doc_id, class_id, n_links, n_texts`` for each row of ``docs(doc_id, text, ...)``.

    class_id: least doc_id of the group that links of Jaccard similarity >= threshold form;
    n_links: other documents linked to it, copies included; n_texts: other linked texts (as
    sets of shingles). Similarities are exact; a pair at the threshold meets with probability
    target, more similar pairs sooner. A text under five words is one shingle. A text without a
    word, or null, has no links and its own doc_id as class_id. Equal rows count as copies. A
    null doc_id is kept; a class has a null class_id only if none of its documents has an id.
    Other columns are unused; an empty table gives no rows.
    """
    grouped, paths = _grouped(docs, words, threshold, target)
    out = stored(grouped.select("doc_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts")), "near")
    for path in paths:
        discard(docs, path)
    return out


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8, target: float = 0.9999) -> DataFrame:
    """Rows of docs, all columns, with one document of each near-duplicate group: the one with the least doc_id (null last), of repeated rows one. Documents without a word all stay."""
    grouped, paths = _grouped(docs, words, threshold, target)
    alone = F.col("set_key").isNull()
    here = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    stay = stored(grouped.where(alone | (here == F.col("one"))).select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), alone.alias("kept_all")).distinct(), "kept")
    for path in paths:
        discard(docs, path)
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("kept_hash") == F.xxhash64("text"))
    kept = nested(docs).join(stay.hint("shuffle_hash"), same)
    once = kept.where("NOT kept_all").dropDuplicates(["kept_id", "kept_hash"])
    return unnested(once.unionByName(kept.where("kept_all")), docs)
