"""Long texts without borders, long runs, and the memory of memo tables."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tarmac.llm import bpe, token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_cuts_stay_balanced(monkeypatch):
    codec = bpe.codec(PATH, PATTERN)
    text = "ab  cd ef " * 2000 + "x" * 30_000
    want = codec._leaf(text)
    monkeypatch.setattr(bpe, "LEAF_CHARS", 16)
    assert codec.encode(text) == want
    assert codec.encode(" " * 50 + "y" * 50) == codec._leaf(" " * 50 + "y" * 50)


def test_long_runs_equal_the_library_in_little_time():
    codec, draw = bpe.codec(PATH, PATTERN), random.Random(6)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    runs = ["a" * 200_000, "0" * 200_000, "-" * 200_000, "=-_" * 66_000, "é" * 100_000, "".join(draw.choice("abcdefgh") for _ in range(200_000))]
    for text in runs:
        start = time.thread_time()
        got = np.frombuffer(codec.encode(text), dtype="<u4").tolist()
        assert time.thread_time() - start < 5
        assert got == library.encode_ordinary(text)


def test_heap_merges_like_the_scan(monkeypatch):
    codec, draw = bpe.codec(PATH, PATTERN), random.Random(9)
    for _ in range(400):
        piece = "".join(draw.choice(draw.choice(["ab", "a", "abc0-é", "the "])) for _ in range(draw.randrange(1, 200))).encode()
        by_heap = codec._merge_by_heap(piece)
        with monkeypatch.context() as m:
            m.setattr(bpe, "LONG", 1 << 30)
            assert codec.merge(piece) == by_heap


@pytest.mark.parametrize("make", [lambda: bpe.Codec(bpe.read_ranks(PATH), PATTERN), lambda: token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))])
def test_memo_tables_keep_no_long_words(make):
    own, draw = make(), random.Random(3)
    for _ in range(20):
        text = " ".join("".join(draw.choice("abcdefgh") for _ in range(2000)) for _ in range(3))
        own.encode(text) if isinstance(own, bpe.Codec) else own.count(text)
    for table in (own._pieces, own._after_space):
        assert all(len(key) <= table.longest for key in table)
