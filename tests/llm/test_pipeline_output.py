"""The pipeline's last stage returns the ids of its sequences."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from wayframe.llm.queries import END_ID


def test_sequences_hold_their_ids(spark):
    texts = {1: "Some words, and some more.\n" * 600, 2: "é", 3: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sorted(corpus_pipeline.pack(spark, docs, "").collect(), key=lambda r: (r.doc_id, r.start))
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in texts.items():
        ids = np.frombuffer(b"".join(r.ids for r in rows if r.doc_id == doc_id), "<u4").tolist()
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, END_ID]
