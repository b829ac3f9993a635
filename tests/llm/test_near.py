"""Near copies and repeated strings against brute force."""

import hashlib
import random
from collections import Counter
from functools import partial

import numpy as np
import pytest

from wayframe.llm import components, lsh_forest, suffix_dedup
from wayframe.llm.bwt import repeated


def corpus(n=60, seed=3):
    """Texts with exact and near copies of several degrees and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(70))
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.randint(60, 200))]
        if rng.random() < 0.4:
            k = rng.randrange(len(base))
            base[k:k] = [passage]
        for _ in range(rng.choice([1, 1, 2, 4, 6])):
            w = " ".join(base).split(" ")
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out


def jaccard_groups(texts, least=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    links = [{j for j in range(len(sets)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])} for i in range(len(sets))]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        stack = [i]
        while stack:
            for y in links[stack.pop()]:
                if label[y] > label[i]:
                    label[y] = label[i]
                    stack.append(y)
    return links, label, sets


@pytest.mark.parametrize("block,crowd", [(192, 1024), (3, 2)])
def test_near_duplicates(spark, monkeypatch, block, crowd):
    monkeypatch.setattr(lsh_forest, "BLOCK", block)
    monkeypatch.setattr(lsh_forest, "CROWD", crowd)
    texts = [*corpus(), "", None, "short text", "short text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, label, sets = jaccard_groups(texts)
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(docs).collect()}
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (label[i], len(links[i])) for i in range(len(texts))}
    assert all(r.n_texts == len({frozenset(sets[j]) for j in links[i]} - {frozenset(sets[i])}) for i, r in got.items())
    kept = {r.doc_id for r in lsh_forest.keep_one(docs).collect()}
    assert kept == set(label)


def test_near_odd(spark, odd, none):
    rows = lsh_forest.near_duplicates(odd).collect()
    assert len(rows) == 9 and {r.class_id for r in rows if r.doc_id == 1} == {1}
    assert [r.n_links for r in rows if r.doc_id == 1] == [1, 1]
    kept = lsh_forest.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.count() == 8
    assert lsh_forest.near_duplicates(none).count() == 0 and lsh_forest.keep_one(none).count() == 0


def test_prefix_is_shortened_to_the_target():
    assert lsh_forest.shortest_prefix(0.8, 0.0) == lsh_forest.DEPTH
    d = lsh_forest.shortest_prefix(0.8, 0.9999)
    assert lsh_forest.meeting_chance(0.8, d) >= 0.9999 > lsh_forest.meeting_chance(0.8, d + 1)


def test_groups_of_a_trie_node():
    """Without similarities in the way all classes of a node are one group; groups that have reached the target aren't compared with one another."""
    forest = lsh_forest.Forest(0.8, 0.9999)
    rng = np.random.default_rng(3)
    near = rng.integers(0, 1 << 16, lsh_forest.TREES * lsh_forest.DEPTH)
    other = near.copy()
    other[: int(len(near) * 0.3)] = rng.integers(0, 1 << 16, int(len(near) * 0.3))  # shows 0.7: passes, yet is no sign of a near copy
    far = rng.integers(0, 1 << 16, len(near))
    label = lambda last: [1, 2, 3, 4, 5, last]
    both = lambda kinds: forest.grouped(np.array([label(k) for k, _ in kinds]), np.array([s for _, s in kinds])).tolist()
    assert both([(1, near), (1, near), (2, near), (3, far)]) == [0, 0, 0, 3]
    assert both([(1, near), (1, near), (2, other), (2, other)]) == [0, 0, 2, 2]  # two groups with all their links found
    assert both([(1, near), (1, near), (2, other)]) == [0, 0, 0]  # a class alone may still miss a partner
    assert both([(1, near), (1, other), (2, near), (2, other)]) == [0, 0, 0, 0]  # weak links: the prefix is shortened
    sides = forest.grouped(np.array([label(1)] * 3), np.array([near] * 3), np.array([0, 0, 1]))
    assert sides.tolist() == [0, 0, 0] and forest.grouped(np.array([label(1)] * 2), np.array([near] * 2), np.array([1, 1])).tolist() == [0, 1]


@pytest.mark.parametrize("at_once", [400_000, 20, 0])
def test_components(spark, at_once):
    connected_components = partial(components.connected_components, at_once=at_once)
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    rng = random.Random(4)
    pairs = [(0, k) for k in range(1, 300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(220)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: y for x, y in label.items() if x in {p for a, b in pairs if a != b for p in (a, b)}}
    assert connected_components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merged_transforms(shards):
    rng = random.Random(shards)
    for t in range(25):
        base = [bytes(rng.choice(b"abcd" if t % 2 else b"ab") for _ in range(rng.randint(0, 700))) for _ in range(4)]
        strings = [b"xy" * 300] * (t % 3)
        for _ in range(rng.randint(0, 12)):
            b = rng.choice(base)
            x = bytearray(b[rng.randint(0, 60) :])
            if x:
                x[rng.randrange(len(x))] = ord("z")
            strings.append(bytes(x))
        count = Counter(s[i : i + 200] for s in strings for i in range(len(s) - 199))
        for s, hit in zip(strings, repeated(strings, 200, shards)):
            assert hit.tolist() == [count[s[i : i + 200]] > 1 for i in range(len(s) - 199)]


@pytest.mark.parametrize("crowd", [2048, 1])
def test_suffix_dedup(spark, monkeypatch, odd, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    texts = [*corpus(40, 8), "ab" * 300, None, "", "x" * 199, "y" * 201]
    rows = [*enumerate(texts), *[(1000 + (r.doc_id or 0), r.text) for r in odd.collect()]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(hash(d[k : k + 200]) for _, d in data for k in range(len(d) - 199))
    want = []
    for i, d in data:
        covered = np.zeros(len(d) + 1, int)
        for k in range(len(d) - 199):
            if count[hash(d[k : k + 200])] > 1:
                covered[k] += 1
                covered[k + 200] -= 1
        covered = np.cumsum(covered)[: len(d)] > 0
        kept = bytes(b for b, c in zip(d, covered) if not c)
        want.append((i, len(d), int(covered.sum()), int((np.diff(np.concatenate([[0], covered])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, suffix_dedup.removal_digests(docs).collect())) == sorted(want)


def removed(rows):
    """Bytes of each text that 200-byte strings with another start cover."""
    count = Counter(hash(d[k : k + 200]) for d in rows for k in range(len(d) - 199))
    out = []
    for d in rows:
        covered = np.zeros(len(d) + 1, int)
        hits = [k for k in range(len(d) - 199) if count[hash(d[k : k + 200])] > 1]
        np.add.at(covered, hits, 1)
        np.add.at(covered, np.array(hits, int) + 200, -1)
        out.append(int((np.cumsum(covered)[: len(d)] > 0).sum()))
    return out


@pytest.mark.parametrize("crowd", [2048, 8])
def test_alike_stretches_and_periodic_texts(spark, monkeypatch, crowd):
    """A passage in many different surroundings, texts of one letter or of a short period, and lines of dashes."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(330)
    texts = [word(rng.randint(0, 250)) + passage[: rng.choice([330, 330, 260, 205, 190])] + word(rng.randint(0, 250)) for _ in range(300)]
    texts += ["a" * 30_000, "b" * 200, "c" * 201, "ab" * 3000, "xyz" * 700 + word(300), "a" * 500 + word(250) + "a" * 450]
    texts += [word(150) + "-" * 120 + word(150) for _ in range(20)] + [(word(170) + "q") * 5, passage[40:300]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.removal_digests(docs).collect()}
    assert [got[k] for k in range(len(texts))] == removed([t.encode() for t in texts])


def test_rows_of_periodic_text():
    """One letter a million times is a row or two, not a million; a long text of random letters has few stretches."""
    assert len(suffix_dedup.stretches([b"a" * 1_000_000])[0]) <= 2
    assert len(suffix_dedup.stretches([b"abcab" * 200_000])[0]) <= 8
    assert len(suffix_dedup.stretches([np.random.default_rng(1).integers(97, 123, 1_000_000).astype(np.uint8).tobytes()])[0]) < 20_000


def test_symbols_are_told_apart_by_their_bytes(monkeypatch):
    from wayframe.llm import bwt

    data = np.frombuffer(bytes(range(97, 123)) * 20, np.uint8)
    at = np.arange(len(data) - bwt.SYMBOL + 1)
    want = bwt._numbered(data, at)
    monkeypatch.setattr(bwt, "run_hashes", lambda sums, inverse, a, b: np.zeros(len(a), np.uint64))
    got = bwt._numbered(data, at)
    assert len(set(got.tolist())) == len(set(zip(got.tolist(), want.tolist()))) == len(set(want.tolist())) == 26


def test_repeats_odd(spark, odd, none):
    out = suffix_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == 9
    assert {r.n_chars for r in out.where("doc_id = 6").collect()} == {len(out.where("doc_id = 6").first().text)}
    assert suffix_dedup.removal_digests(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0
