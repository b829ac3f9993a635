"""Byte-pair encoding by a token automaton.

The automaton reads tokens. It accepts a token sequence exactly if that is the encoding of the
word it spells. It starts as one state with an arc for each base symbol, and each merge (u, v)
-> w, in order of priority, adds a gadget: the state that arcs on u lead to is copied without
its arc on v, arcs on u then lead to the copy, and every state with an arc on u gets an arc on
w, which leads where v led. All arcs on one token lead to one state, so the automaton is
deterministic.

The transition table has a row for each state. Arcs are numbered so that what a state lacks is
a few ranges: a state without the arc on v never gets arcs on tokens that later merges make
with v as their left part, and numbers go depth first through the tree of left parts, later
tokens first, so these follow v. A row is the sorted bounds of its ranges.

Words come as symbols, not tokens. The arcs' labels are spelled out in a second table, a trie of
all tokens with failure links, which one step a symbol follows; it gives the tokens that end at
a place. Each beginning of a word has a single encoding, so at most one of them continues the
one recorded at its own beginning: one pass records the last token of every beginning, and the
path is read back from the end. The time is linear in the word.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import steps

#: Words that a worker keeps at most; beyond it the store starts anew. Longer words than LONGEST_WORD aren't kept.
MOST_WORDS, LONGEST_WORD = 600_000, 64
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """For each byte the character that stands for it in byte-level vocabularies: printable bytes stand for themselves, others for characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (chr(0x100 + k) for k in range(256))
    return [chr(b) if b in shown else next(hidden) for b in range(256)]


class TokenAutomaton:
    """The automaton of a merge list. base: symbols that no merge makes; merges: (left, right) by priority."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]]):
        tokens, spelled = {s: k for k, s in enumerate(base)}, [(s,) for s in base]
        made, after = [0] * len(base), [[] for _ in base]  # the merge that makes a token; tokens made with it as the left part
        gadgets = []
        for k, (a, b) in enumerate(merges, 1):
            u, v = tokens.get(a), tokens.get(b)
            if u is None or v is None or a + b in tokens:
                continue  # such a merge never applies
            w = tokens[a + b] = len(spelled)
            spelled.append(spelled[u] + spelled[v])
            made.append(k), after.append([]), after[u].append(w)
            gadgets.append((k, u, v, w))
        self.names = list(tokens)
        self.number, past = self._numbered(len(base), after)

        self.state, rows = [0] * len(spelled), [[]]
        lost = [False] * len(spelled)
        for k, u, v, w in gadgets:
            row, at = rows[self.state[u]], self.number[v]
            if lost[u] or lost[v] or bisect_right(row, at) & 1:
                lost[w] = True  # u is never followed by v at this point
                continue
            earlier = bisect_left(after[v], k, key=made.__getitem__)
            upto = self.number[after[v][earlier - 1]] if earlier else past[v]
            place = bisect_right(row, at)
            self.state[w] = self.state[v]
            self.state[u] = len(rows)
            rows.append([*row[:place], at, upto, *row[place:]])
        used = {s: k for k, s in enumerate(sorted(set(self.state)))}  # a copy that was copied again is no longer led to
        self.rows = [array("i", rows[s]) for s in used]
        self.state = [used[s] for s in self.state]
        self.size = [len(x) for x in spelled]
        self._spell([(t, x) for t, x in enumerate(spelled) if not lost[t]])

    @staticmethod
    def _numbered(base: int, after: list[list[int]]) -> tuple[list[int], list[int]]:
        """Each token's place in the tree of left parts, later tokens first, and the first place past all that begin with it."""
        number, past, n = [0] * len(after), [0] * len(after), 0
        for root in range(base):
            stack = [root]
            while stack:
                t = stack.pop()
                if t < 0:
                    past[~t] = n
                    continue
                number[t] = n
                n += 1
                stack += [~t, *after[t]]
        return number, past

    def _spell(self, tokens: list[tuple[int, tuple[str, ...]]]) -> None:
        """The trie: next nodes by symbol, where to go on failure, and the tokens that end at a node (with their number and length), longest first."""
        self.next: list[dict[str, int]] = [{}]
        own: list[tuple] = [()]
        for t, symbols in tokens:
            node = 0
            for x in symbols:
                to = self.next[node].get(x)
                if to is None:
                    to = self.next[node][x] = len(self.next)
                    self.next.append({}), own.append(())
                node = to
            own[node] = ((t, self.number[t], len(symbols)),)
        self.fail, self.ends = [0] * len(own), own
        queue = list(self.next[0].values())
        for node in queue:
            for x, to in self.next[node].items():
                self.fail[to] = self.step(self.fail[node], x)
                queue.append(to)
            self.ends[node] = own[node] + self.ends[self.fail[node]]

    def step(self, node: int, symbol: str) -> int:
        """The next node of the trie."""
        while (to := self.next[node].get(symbol)) is None and node:
            node = self.fail[node]
        return to or 0

    def has_arc(self, last: int, token: int) -> bool:
        """Whether the state that arcs on last lead to has an arc on token."""
        return not bisect_right(self.rows[self.state[last]], self.number[token]) & 1

    def encode(self, symbols: list[str]) -> list[int]:
        """The one accepted path that spells the word."""
        following, fail, ends, rows, state = self.next, self.fail, self.ends, self.rows, self.state
        last, node = [-1], 0  # the last token of each beginning
        for place, x in enumerate(symbols, 1):
            while (to := following[node].get(x)) is None and node:
                node = fail[node]
            node = to or 0
            for token, number, size in ends[node]:
                before = last[place - size]
                if before < 0 or not bisect_right(rows[state[before]], number) & 1:
                    last.append(token)
                    break
            else:
                raise ValueError("a symbol isn't in the vocabulary")
        path, at = [], len(symbols)
        while at:
            path.append(last[at])
            at -= self.size[last[at]]
        path.reverse()
        return path


class WordCodec:
    """Encodes and decodes as the tokenizers library does with a word-end BPE file (white space dropped, byte symbols). Ids come from the automaton, not from the library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)  # its normaliser and splitter only
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        plain = byte_symbols()
        self.byte = dict(enumerate(plain))
        self.automaton = TokenAutomaton([*plain, *(s + self.end for s in plain)], merges)
        self.ids = [model["vocab"].get(s, -1) for s in self.automaton.names]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.labels = {**{i: s for s, i in model["vocab"].items()}, **{i: s for s, i in self.special.items()}}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.known_words: dict[str, tuple[bytes, str]] = {}

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs; the file has no decoder, so a space parts them."""
        return " ".join([self.labels[i] for i in ids])

    def word(self, word: str) -> tuple[bytes, str]:
        """A word of byte symbols."""
        found = self.known_words.get(word)
        if found is None:
            ids = [self.ids[t] for t in self.automaton.encode([*word[:-1], word[-1] + self.end])]
            found = array("I", ids).tobytes(), self.decode(ids)
            if len(word) <= LONGEST_WORD:
                self.known_words[word] = found
        return found

    def _ordinary(self, text: str) -> list[tuple[bytes, str]]:
        """Normalised and split as the file says: by the library where Unicode's tables matter, which ASCII doesn't need."""
        if text.isascii():
            words = self.words.findall(text.lower())
            return [self.word(w if w.isprintable() else w.translate(self.byte)) for w in words]
        return [self.word(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def piece(self, piece: str) -> tuple[bytes, str]:
        """A text, or a part of it between white space."""
        if self.at_special is None or "<" not in piece:
            parts = self._ordinary(piece)
        else:
            parts = [x for part in self.at_special.split(piece) for x in ([(array("I", [self.special[part]]).tobytes(), part)] if part in self.special else self._ordinary(part))]
        found = parts[0] if len(parts) == 1 else (b"".join([x for x, _ in parts]), " ".join([t for _, t in parts]))
        if len(piece) <= LONGEST_WORD:
            self.known[piece] = found
        return found

    def run(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        if len(self.known_words) > MOST_WORDS:
            self.known_words.clear()
        pieces = [text] if _SEPARATORS.search(text) else text.split()
        known, piece = self.known, self.piece
        found = [known.get(p) or piece(p) for p in pieces]
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[1]])


@lru_cache(maxsize=1)
def codec(path: str) -> WordCodec:
    """The worker's own codec, kept between tasks."""
    return WordCodec(path)


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Round trip of ``docs(doc_id, text, ...)``: ``doc_id, n_tokens, ids, decoded``, one row for each row.

    A null text is an empty one: no ids, an empty text. Null doc_id stays null, repeated rows
    are kept, other columns are unused, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(tokenizer).run
        for batch in steps(batches):
            both = [one(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x, _ in both], pa.int64()), pa.array([x for x, _ in both], pa.binary()), pa.array([t for _, t in both], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encode_decode, taken in the worker so that ids and texts needn't return to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(tokenizer).run
        for batch in steps(batches):
            both = [one(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array([hashlib.sha256(x).hexdigest() for x, _ in both]), pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in both])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x, _ in both], pa.int64()), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
