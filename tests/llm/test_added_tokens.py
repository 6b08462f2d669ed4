"""Packing against the plain call of a tokenizer with default settings, on texts that hold added tokens."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from locusfold.llm import packing

PACK = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_as_in_the_plain_call(spark):
    tok = Tokenizer.from_file(PACK)
    added = tok.get_added_tokens_decoder()
    assert "<|endoftext|>" in {t.content for t in added.values()}
    texts = [
        "hello <|endoftext|> there", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "a<|endoftext|>b <|endoftext|", "<|endoftext >|>", "été <|endoftext|>\n\n 😀",
        "plain words only", "", " word" * 50 + " <|endoftext|> " + " word" * 50,
    ]
    want = {}
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        head = len(ids) % 16 or 16
        edges = [0, len(ids)] if len(ids) <= 16 else [0, *range(head, len(ids) + 1, 16)]
        want.update({(i, k): (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))})
    assert tok.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 612]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.pack_documents(docs, PACK, capacity=16).collect()}
    assert got == want
