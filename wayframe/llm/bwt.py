"""Burrows-Wheeler transforms of shards, and their merge by iterative interleave refinement.

The strings are byte strings; a symbol is a block of SYMBOL bytes, so the suffix at each byte
place is a string of whole symbols (its place's phase) and ends in a terminator of its own.
Symbols are numbered in any order; their bytes are compared, so equal numbers mean equal bytes.

A shard's transform lists, for its suffixes in order, the symbol before each. The merge starts
with the shards one after another and refines: after step h the interleave orders all suffixes
by their first h symbols. A step reads the transforms along the interleave and deals shard
numbers into buckets by symbol, keeping their order; no suffix is compared or sorted again. A
boundary that appears between neighbours at step h means a common prefix of h - 1 symbols.
"""

from __future__ import annotations

import numpy as np

from .shingles import _INVERSE, _powers, mixed

SYMBOL = 25


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rolling hashes: sums of byte * base**place, and the inverse powers."""
    power, inverse = _powers(1 << max(20, (len(data) + 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return sums, inverse


def run_hashes(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many runs; runs of different lengths differ."""
    with np.errstate(over="ignore"):
        return mixed((sums[ends] - sums[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(_INVERSE))


def _numbered(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for the SYMBOL bytes at each place: by hash, and by the bytes themselves should two differ under one hash."""
    sums, inverse = prefix_sums(data)
    _, first, number = np.unique(run_hashes(sums, inverse, at, at + SYMBOL), return_index=True, return_inverse=True)
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))  # eight bytes from every place
    like = at[first[number]]
    parts = (0, 8, 16, SYMBOL - 8)
    if all((words[at + k] == words[like + k]).all() for k in parts):
        return number
    return np.unique(np.stack([words[at + k] for k in parts], axis=1), axis=0, return_inverse=True)[1].ravel()


def _ordered(symbols: np.ndarray, after: np.ndarray, depth: int) -> np.ndarray:
    """A shard's suffixes in the order of their first depth symbols (depth a power of two).

    symbols: number of each suffix's first symbol, below zero for terminators (each its own);
    after: the suffix that follows the first symbol (itself for terminators). Doubling: ranks
    by w symbols give ranks by 2w.
    """
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, step, w = rank.astype(np.int64), after, 1
    order = np.argsort(rank, kind="stable")
    while w < depth:
        key = rank * n + rank[step]
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, step, w = new, step[step], 2 * w
    return order


def merged(transforms: list[np.ndarray], ends: list[int], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave (shard numbers in merged order) and common prefixes (symbols shared with the neighbour before, ``steps`` if that many or more).

    transforms: for each shard the symbol before each suffix in the shard's order, -1 for none;
    ends: its number of terminators, which come first in its order.
    """
    sizes = [len(t) for t in transforms]
    n, first = sum(sizes), sum(ends)
    z = np.repeat(np.arange(len(sizes), dtype=np.uint8), sizes)
    block = np.zeros(n, np.int32)
    common = np.full(n, steps, np.int16)
    common[0] = 0
    fronts = np.repeat(np.arange(len(sizes), dtype=np.uint8), ends)
    low = (1 << 32) - 1
    for h in range(1, steps + 1):
        before = np.empty(n, np.int64)
        for s, t in enumerate(transforms):
            before[z == s] = t
        at = np.flatnonzero(before >= 0)
        key = (before[at] << 32) | at
        key.sort()
        place = key & low
        z = np.concatenate([fronts, z[place]])
        symbol, old = key >> 32, block[place]
        new = np.ones(n, bool)
        new[first + 1 :] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        common[new & (common == steps)] = h - 1
        block = np.cumsum(new, dtype=np.int32)
    common[0] = 0
    return z, common


def repeated(strings: list[bytes], length: int, shards: int = 4) -> list[np.ndarray]:
    """For each string, at which places a run of ``length`` bytes starts that also starts elsewhere in the strings (a boolean for each start). length: a multiple of SYMBOL by a power of two."""
    steps = length // SYMBOL
    if length % SYMBOL or steps & (steps - 1):
        raise ValueError("length must be SYMBOL times a power of two")
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    if not len(data):
        return [np.zeros(max(0, n - length + 1), bool) for n in sizes]
    # A suffix for each place 0 .. size of each string; those with under SYMBOL bytes left are terminators.
    of = np.repeat(np.arange(len(strings)), sizes + 1)
    place = np.arange(len(of)) - np.repeat(begins[:-1] + np.arange(len(strings)), sizes + 1)
    left = sizes[of] - place
    whole = left >= SYMBOL
    symbol = np.empty(len(of), np.int64)
    if whole.any():
        symbol[whole] = _numbered(data, (begins[of] + place)[whole])
    symbol[~whole] = np.arange(-int((~whole).sum()), 0)
    start_of = begins[:-1] + np.arange(len(strings))
    cuts = np.searchsorted(np.cumsum(sizes), len(data) * np.arange(1, shards) / shards) + 1
    bounds = [0, *sorted({min(int(c), len(strings)) for c in cuts} - {len(strings)}), len(strings)]
    transforms, orders, ends = [], [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        lo, hi = int(start_of[a]), int(start_of[b]) if b < len(strings) else len(of)
        here = np.arange(lo, hi)
        after = np.where(whole[lo:hi], here + SYMBOL, here) - lo
        order = _ordered(symbol[lo:hi], after, steps) + lo
        orders.append(order)
        transforms.append(np.where(place[order] >= SYMBOL, symbol[order - SYMBOL], -1))
        ends.append(int((~whole[lo:hi]).sum()))
    z, common = merged(transforms, ends, steps)
    suffix = np.empty(len(z), np.int64)
    for s, order in enumerate(orders):
        suffix[z == s] = order
    same = common >= steps
    again = same.copy()
    again[:-1] |= same[1:]
    hit = np.zeros(len(of), bool)
    hit[suffix[again]] = True
    return [hit[s : s + max(0, n - length + 1)] for s, n in zip(start_of.tolist(), sizes.tolist())]
