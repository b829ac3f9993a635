"""Encoding by the tokenizers library with each distinct piece of text encoded once per worker.

A tokenizer that never joins text across white space gives a text the ids of its pieces in
order. Words repeat far more often than texts, so a worker keeps the ids of pieces it has met
and asks the library for new ones only. The store of pieces is bounded.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import regex
from tokenizers import Tokenizer

from .bpe_automaton import byte_symbols

#: Pieces that a worker keeps at most; beyond it the store starts anew. Longer pieces aren't kept.
MOST_PIECES, LONGEST_PIECE = 1_000_000, 64
#: Python counts these as white space; Unicode's White_Space, which the libraries go by, does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: White space other than a space and \n.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A space goes with the word after it; of a longer run all but the last character stay together.
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: The byte-level pattern of the vocabulary files (a fixed value).
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class PieceEncoder:
    """Texts to ids (bytes of little-endian unsigned 32-bit integers) by one tokenizer file.

    spaced: white space is part of the tokens (byte-level BPE); else it is dropped.
    """

    def __init__(self, path: str, spaced: bool):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.spaced, self.known, self.known_words = spaced, {}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = _BYTE_LEVEL if spaced else regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.byte, self.model = dict(enumerate(byte_symbols())), self.library.model

    def pieces(self, text: str) -> list[str] | None:
        """Pieces that can be encoded one by one; None if the text must be encoded as a whole."""
        if _SEPARATORS.search(text):
            return None
        if not self.spaced:
            return text.split()
        if "  " in text or _OTHER_SPACE.search(text):
            return _SPACED.findall(text)
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if not line or line[0] == " " or line[-1] == " ":
                return _SPACED.findall(text)
            if k:
                out.append("\n")
            first, *rest = line.split(" ")
            out.append(first)
            out += [" " + x for x in rest]
        return out

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A word of byte symbols, by the library's model."""
        found = self.known_words.get(word)
        if found is None:
            found = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
            if len(word) <= LONGEST_PIECE:
                self.known_words[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        """Normalised and split as the file says: by the library where Unicode's tables matter, which ASCII doesn't need."""
        if any(x in piece for x in self.special):
            found = self._library(piece)
        elif piece.isascii():
            words = self.words.findall(piece if self.spaced else piece.lower())
            found = b"".join([self._word(w.translate(self.byte)) for w in words])
        else:
            text = piece if self.spaced else self.library.normalizer.normalize_str(piece)
            found = b"".join([self._word(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)])
        if len(piece) <= LONGEST_PIECE:
            self.known[piece] = found
        return found

    def one(self, text: str) -> bytes:
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        if len(self.known_words) > MOST_PIECES:
            self.known_words.clear()
        pieces = self.pieces(text)
        if pieces is None:
            return self._library(text)
        known, piece = self.known, self._piece
        return b"".join([known[p] if p in known else piece(p) for p in pieces])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.one(t or "") for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool) -> PieceEncoder:
    """The worker's own encoder, kept between tasks."""
    return PieceEncoder(path, spaced)
