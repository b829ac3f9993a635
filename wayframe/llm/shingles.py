"""Word shingles of many texts at once, as 64-bit hashes (numpy, no loop over words)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for b in (_BASE, _INVERSE):
        factors = np.full(n, b, np.uint64)
        factors[0] = 1
        both.append(np.multiply.accumulate(factors))
    return both[0], both[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (splitmix64's finish)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by one space, and where each begins (a last entry: the end). Null: empty."""
    parts = [t if t is not None else b"" for t in texts.cast(pa.binary()).to_pylist()]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of that many words.

    Words are parted by ASCII white space. A text with fewer words (one at least) has one
    shingle, all its words; a text without a word, or null, has none.
    """
    data, begins = text_bytes(texts)
    n = len(data)
    power, inverse = _powers(1 << max(20, (n + 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        word = mixed((sums[ends] - sums[starts]) * inverse[starts])
        of = np.searchsorted(starts, begins)  # each text's first word
        run = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k in range(words):
            run = (run + word[k : len(word) - words + 1 + k]) * np.uint64(_BASE)
        run = mixed(run)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                h = np.uint64(b - a)
                for w in word[a:b]:
                    h = (h + w) * np.uint64(_BASE)
            out.append(mixed(np.array([h], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
