"""Token operators against the public libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarmac.llm import bpe, queries, token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(5)
    sets = ["aaabbe  \n\t'sréßñ日本語한국😀1²½٣_-.,!# 　\x1c\x85", "ab", "etaoinshrdlu", "etaoin ", "日本語한국漢字"]
    out = ["", " ", "  ", "\n \n", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "don't  I'll\n\n"]
    out += ["".join(rng.choice(s) for _ in range(rng.randint(1, 120))) for s in sets for _ in range(60)]
    out += ["".join(rng.choice("etaoin shrd\n") for _ in range(30_000)), "q" * 20_000, "ab" * 9000]
    return out


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_tree_encoding_is_the_library_s(reference):
    own = bpe.codec(PATH, PATTERN)
    for text in texts():
        ids = np.frombuffer(own.encode(text), dtype="<u4").tolist()
        assert ids == reference.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_join_of_any_two_parts(reference):
    own = bpe.codec(PATH, PATTERN)
    word = "internationalisierungsbestrebungen"
    whole = own.encode_piece(word.encode())
    for cut in range(len(word) + 1):
        assert own.join(own.tree(word[:cut].encode()), own.tree(word[cut:].encode())) == own.tree(word.encode())
    assert whole == reference.encode_ordinary(word)


def test_counts_are_the_library_s():
    library, own = Tokenizer.from_file(JSON), token_counts.counter(JSON)
    for text in texts():
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_tables_with_nulls_and_clashing_names(spark):
    rows = [(1, "a b", "kept"), (None, None, None), (1, "a b", "kept"), (2, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = bpe.encode_and_decode(df, PATH, PATTERN)
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in done.collect()) == [(0, b""), (1, b"a b"), (1, b"a b"), (2, b"")]
    apart = bpe.decode_ids(bpe.encode_texts(df, PATH, PATTERN), PATH, PATTERN)
    assert sorted(bytes(r.ids) for r in apart.collect()) == sorted(bytes(r.ids) for r in done.collect())
    counted = token_counts.with_token_counts(df.withColumn("n_tokens", F.lit("old")), JSON, limit=1)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in counted.collect()) == [(0, 0, False)] * 2 + [(3, 2, True)] * 2
    assert bpe.encode_and_decode(df.limit(0), PATH, PATTERN).count() == 0
    assert token_counts.with_token_counts(df.limit(0), JSON).count() == 0


def test_registered_queries(spark, sf_dir, reference):
    library = Tokenizer.from_file(JSON)
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    encoded = queries.QUERIES["op1_bpe"](spark, sf_dir).collect()
    assert len(encoded) == len(documents)
    for r in encoded:
        ids = reference.encode_ordinary(documents[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(documents[r.doc_id].encode()).hexdigest()
    for r in queries.QUERIES["op5_token_counts"](spark, sf_dir).collect():
        n = len(library.encode(documents[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(documents[r.doc_id].encode()), n > 512)
