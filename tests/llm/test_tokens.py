"""Token ids against an independent implementation of the same vocabulary."""

import base64
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from garimpo.functions import codepoints as cp
from garimpo.llm import tokens as tk

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
pytestmark = pytest.mark.skipif(not os.path.isdir(tk.TOKENIZERS), reason="no vocabulary files")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{tk.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts, limit=cp.SPAN_BYTES, seen=tk.SEEN_WORDS):
    encoder, out = tk.Encoder(tk.load_merges(), seen), []
    for _, t in cp.spans(pa.array(texts, pa.string()), limit):
        flat, off = encoder.id_lists(t)
        assert np.diff(off).tolist() == encoder.sizes(t).tolist()
        out += [flat[off[i] : off[i + 1]].tolist() for i in range(t.rows)]
    return out


EDGE = [
    "", None, " ", "   ", "\n\n", "it's we're I'll 'tis 'x ''s x'S a  b   c \n\n d\t e f  ", "don't'", "'", "'s", "'re", "'r", " 's",
    "x　 y", "a\x1cb\x85c", "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 3000, "日本語" * 500, "👩‍🔬👍🏽", "١٢٣ ½", "\x00﻿",
]


def test_edges(reference):
    assert encode(EDGE) == [reference.encode_ordinary(t or "") for t in EDGE]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cn"]), max_size=40), max_size=8), st.integers(1, 60))
def test_any_text(reference, texts, limit):
    assert encode(texts, limit, seen=3) == [reference.encode_ordinary(t) for t in texts]


def test_long_text_in_parts(reference, monkeypatch):
    monkeypatch.setattr(tk, "LONG_TEXT", 500)
    r = random.Random(1)
    texts = ["".join(r.choice("ab1 '\n\t srtemdlvá٣漢🙂-._") for _ in range(20_000)), "x" * 3000, " " * 3000, "ab " * 2000 + "  don't  "]
    assert encode(texts, 10) == [reference.encode_ordinary(t) for t in texts]


def test_equal_hashes_are_told_apart():
    """Words that share a hash must keep their own ids."""
    encoder = tk.Encoder(tk.load_merges())
    original = np.unique

    def colliding(values, **kw):
        return original(values % np.uint64(3), **kw)

    np.unique = colliding
    try:
        flat, off = encoder.id_lists(next(cp.spans(pa.array(["um dois três dois um quatro"])))[1])
    finally:
        np.unique = original
    assert flat.tolist() == encode(["um dois três dois um quatro"])[0]


def test_column(spark, reference):
    rows = [(1, "um texto", 7, "x"), (2, None, 8, "y"), (None, "", None, None), (1, "um texto", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, `__text` string")
    got = tk.encode_corpus(df)
    assert dict(got.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((r[0], reference.encode_ordinary(r[1] or "")) for r in rows), key=str)
    assert tk.encode_corpus(df.limit(0)).count() == 0
    assert {r["tokens"] for r in tk.count_tokens(df, ["doc_id"]).collect()} == {0, len(reference.encode_ordinary("um texto"))}
