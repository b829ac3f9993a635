"""Encoders against the tokenizers library; token files, packing and the automaton's round trip."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wayframe.llm import bpe_automaton, packing, token_files
from wayframe.llm.common import shared_dir
from wayframe.llm.tokens import PieceEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def texts(n=800):
    rng = random.Random(5)
    odd = "aAbB  \n\t.,'’sStTéÉßΣσςİ½²Ⅳ٣3 12<|>\x1c\x85  　é한漢\U0001f600_-"
    made = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    made += ["".join(rng.choice("thein") for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return made + ["", " ", "\n\n\n", "a  b \n c", "a<|endoftext|>b <|startoftext|>", "x" * 5000, "aaaa" * 9, "don't we'll I'M"]


@pytest.mark.parametrize("path,spaced", [(WORD, False), (BYTE, True)])
def test_pieces_encode_as_whole_texts(path, spaced):
    lib, mine = library(path), PieceEncoder(path, spaced)
    for _ in range(2):  # the second time from the store
        for t, got in zip(texts(), mine.encode(texts())):
            assert np.frombuffer(got, np.uint32).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_automaton_is_the_library():
    lib, mine = library(WORD), bpe_automaton.WordCodec(WORD)
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        got, decoded = mine.run(t)
        assert np.frombuffer(got, np.uint32).tolist() == ids, repr(t)
        assert decoded == lib.decode(ids, skip_special_tokens=False)


def test_small_automaton_is_merging():
    """All words over three letters against plain merging by priority."""
    rng = random.Random(1)
    for _ in range(30):
        symbols, merges = list("abc"), []
        for _ in range(12):
            a, b = rng.choice(symbols), rng.choice(symbols)
            if a + b not in symbols:
                symbols.append(a + b)
                merges.append((a, b))
        auto = bpe_automaton.TokenAutomaton(list("abc"), merges)
        for _ in range(200):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            parts = list(word)
            for a, b in merges:
                out, k = [], 0
                while k < len(parts):
                    if k + 1 < len(parts) and (parts[k], parts[k + 1]) == (a, b):
                        out.append(a + b)
                        k += 2
                    else:
                        out.append(parts[k])
                        k += 1
                parts = out
            assert [auto.names[t] for t in auto.encode(list(word))] == parts


def test_automaton_accepts_encodings_only():
    """Every sequence of two or three tokens is accepted exactly if encoding what it spells gives it back."""
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "b"), ("b", "b"), ("aba", "ba"), ("a", "ab")]
    auto = bpe_automaton.TokenAutomaton(list("ab"), merges)
    n = len(auto.names)
    sequences = [(x, y) for x in range(n) for y in range(n)] + [(x, y, z) for x in range(n) for y in range(n) for z in range(n)]
    for path in sequences:
        accepted = all(auto.has_arc(x, y) for x, y in zip(path, path[1:])) and all(auto.encode(list(auto.names[t])) == [t] for t in path)
        assert accepted == (auto.encode(list("".join(auto.names[t] for t in path))) == list(path)), path


def test_long_words_take_linear_time():
    import time

    codec = bpe_automaton.WordCodec(WORD)
    rng = random.Random(2)
    words = ["a" * 1_000_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))]
    began = time.time()
    found = [codec.run(w) for w in words]
    assert time.time() - began < 60  # some seconds; more than linear would be minutes
    lib = library(WORD)
    assert np.frombuffer(codec.run(words[1][:20_000])[0], np.uint32).tolist() == lib.encode(words[1][:20_000], add_special_tokens=False).ids
    assert all(t.replace(" ", "").removesuffix("</w>") == w for (_, t), w in zip(found, words))


@pytest.mark.parametrize("pattern", ["{}", "a{}b", "1{}1", "e{}\u0301", "{}\u0323\u0301x", "\u1100{}\u1161"])
def test_all_code_points(pattern):
    """Every code point of the first two planes (of the first alone, and without most of its ideographs and syllables, next to combining marks) and every 64th of the others, in words of a thousand a text, as the library has it (both vocabularies)."""
    dense = [range(0x20000)] if pattern in ("{}", "a{}b") else [range(0x3400), range(0xA000, 0xAC00), range(0xD7A0, 0x10000)]
    points = [chr(c) for c in sorted({c for r in (*dense, range(0, 0x110000, 64)) for c in r}) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(pattern.format(c) for c in points[k : k + 1000]) for k in range(0, len(points), 1000)]
    for path, spaced in ((WORD, False), (BYTE, True)):
        lib, mine = library(path), PieceEncoder(path, spaced)
        want = [np.array(e.ids, np.uint32).tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert [hex(1000 * k) for k, (a, b) in enumerate(zip(mine.encode(texts), want)) if a != b] == []
        if not spaced:
            codec = bpe_automaton.WordCodec(path)
            assert [hex(1000 * k) for k, (t, b) in enumerate(zip(texts, want)) if codec.run(t)[0] != b] == []


def test_round_trip_query(spark, odd, none):
    lib = library(WORD)
    rows = bpe_automaton.round_trip_digests(odd, WORD).collect()
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert {r.doc_id: r.decoded for r in bpe_automaton.encode_decode(odd, WORD).collect()}[3] == ""
    assert bpe_automaton.round_trip_digests(none, WORD).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 24, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 5000, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == (5000 * bits + 7) // 8
    assert (token_files.unpack(data, bits, 5000) == ids).all()
    assert token_files.bits_for(49_408) == 16 and token_files.bits_for(2) == 1 and token_files.bits_for(257) == 9


def test_random_access(tmp_path):
    ids = np.random.default_rng(2).integers(0, 50_000, 7000).astype(np.uint32)
    with open(tmp_path / "f", "wb") as f:
        w = token_files.Writer(f, 17)
        w.add([1, None, 3], [ids[:2000], ids[2000:2000], ids[2000:]])
        w.close()
    r = token_files.Reader(pa.memory_map(str(tmp_path / "f")))
    doc_ids, nulls, starts = r.documents(0, 3)
    assert doc_ids.tolist() == [1, 0, 3] and starts.tolist() == [0, 2000, 2000, 7000] and nulls.tolist() == [False, True, False]
    assert [x.tolist() for x in r.documents(1, 3)] == [[0, 3], [True, False], [2000, 2000, 7000]]
    assert r.checksums(starts) == [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in ((0, 2000), (2000, 2000), (2000, 7000))]
    for a, b in ((0, 7000), (1023, 1025), (1024, 2048), (6999, 7000), (5, 5)):
        assert (r.ids(a, b) == ids[a:b]).all()


@pytest.mark.parametrize("file_bytes,read_docs,read_ids", [(token_files.FILE_BYTES, token_files.READ_DOCS, token_files.READ_IDS), (1, 2, 1000)])
def test_token_files(spark, odd, none, monkeypatch, file_bytes, read_docs, read_ids):
    monkeypatch.setattr(token_files, "READ_DOCS", read_docs)
    monkeypatch.setattr(token_files, "READ_IDS", read_ids)
    monkeypatch.setattr(token_files, "steps", lambda batches: (b.slice(k, 1) for b in batches for k in range(b.num_rows)))
    lib, path = library(WORD), shared_dir(spark, "test-tokens")
    files = token_files.write_token_files(odd, path, WORD, 49_408, 1, file_bytes=file_bytes)
    assert file_bytes > 1 or files.count() == 9  # a file for each step
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 5, 5, 6, 7]
    start = 0
    by_text = {(r.doc_id, zlib.crc32(np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in odd.select("doc_id", "text").collect()}
    for r in rows:
        assert r.start == start and (r.doc_id, r.ids_crc32) in by_text
        start += r.n_tokens
    assert token_files.encode_documents(none, WORD, 49_408, 1).count() == 0


def test_packing(spark, odd, none):
    lib = library(BYTE)
    rows = packing.pack_documents(odd, BYTE, 1).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length in {1 << k for k in range(12)} for r in rows)
    for doc in odd.where("doc_id in (1, 2, 3, 6, 7)").select("doc_id", "text").distinct().collect():
        ids = [*lib.encode(doc.text or "", add_special_tokens=False).ids, 1]
        own = sorted({(r.start, r.length, r.ids, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == doc.doc_id})
        assert b"".join(bytes(p[2]) for p in own) == np.array(ids, "<u4").tobytes()
        assert all(p[3] == zlib.crc32(p[2]) and p[4] == len(ids) for p in own)
    assert packing.pack_documents(none, BYTE, 1).count() == 0
    path = shared_dir(spark, "test-buckets")
    packing.write_buckets(packing.pack_documents(odd, BYTE, 1), path)
    for length in (1, 8, 2048):
        want = sorted((r.doc_id or -1, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows if r.length == length)
        assert sorted((r.doc_id or -1, r.start, r.ids) for r in packing.read_bucket(spark, path, length).collect()) == want
    assert packing.piece_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    with pytest.raises(ValueError):
        packing.pack_documents(odd, BYTE, 1, length=1000)
