"""Packed ids against the tokenizer as it comes, on texts that hold its added token."""

import zlib

import numpy as np

from featlake.llm import packing

TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "one <|endoftext|> two\n<|endoftext|><|endoftext|>", "a<|endoftext|", "<|endoftext|> it's 12 ünï 😀", "  x  <|endoftext|>  y  ", "plain <|im_end|> text", ""]


def test_ids_equal_the_unmodified_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = packing.pack(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).toPandas()
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, packing.END], "<u4")
        p = r[r.doc_id == i].sort_values("start")
        assert p.length.sum() == len(ids) and (p.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(p.start, p.length, p.ids_crc32, strict=True))
