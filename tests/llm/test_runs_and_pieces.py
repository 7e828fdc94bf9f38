"""Periodic runs against brute force, piece encoding against the public library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tarmac.llm import periodic_runs, piece_bpe, queries
from tarmac.llm.common import Memo

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def runs_by_brute_force(words, exponent=4, least=6):
    n, found = len(words), []
    for p in range(1, n):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, exponent * p):
                if not any(words[i : i + length - q] == words[i + q : i + length] for q in range(1, p)):
                    found.append((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 1), (2, 7)])
def test_runs_of_random_texts(exponent, least):
    draw = random.Random(exponent * 10 + least)
    for _ in range(250):
        texts = []
        for _ in range(draw.randrange(1, 5)):
            words = [b"w%d" % draw.randrange(draw.choice([1, 2, 3, 8])) for _ in range(draw.randrange(70))]
            if words and draw.random() < 0.5:
                at = draw.randrange(len(words))
                period = 1 + (len(words) - at) // draw.randrange(3, 8)
                words = words[:at] + [words[at + i % period] for i in range(len(words) - at)]
            texts.append(words)
        assert periodic_runs.runs_of_texts(texts, exponent, least) == [runs_by_brute_force(w, exponent, least) for w in texts]


def test_positions_stay_in_order_over_blocks():
    draw = random.Random(4)
    values = draw.sample(range(100_000), 6000)
    held = periodic_runs.Positions(values[0])
    for v in values[1:]:
        held.add(v)
    want = sorted(values)
    assert list(held) == want and held.size == len(want) and len(held.blocks) > 2
    assert all(held.around(want[i]) == (want[i - 1] if i else None, want[i + 1] if i + 1 < len(want) else None) for i in range(0, len(want), 7))
    assert held.around(want[-1])[1] is None


@pytest.mark.parametrize("words", [[b"a"] * 100_000, [b"a", b"b", b"c"] * 30_000, [b"%d" % (i * i % 7919) for i in range(100_000)]])
def test_long_periodic_texts(words):
    (runs,) = periodic_runs.runs_of_texts([words])
    want = [(0, len(words), next(p for p in (1, 3, 7919) if words[p:] == words[:-p]))]
    assert runs == want
    assert len(periodic_runs.collapsed(words, runs).split()) == want[0][2]


def test_runs_edge_cases(spark):
    rows = [(1, "x x x x x x y"), (1, "x x x x x x y"), (2, None), (3, ""), (None, "a b " * 4), (4, "one two one two"), (5, "q " * 5)]
    df = spark.createDataFrame([(*r, "old", "k") for r in rows], "doc_id long, text string, runs string, _both string")
    done = periodic_runs.with_runs(df)
    assert sorted(done.columns) == sorted([*df.columns, "collapsed"])
    got = {(r.doc_id, r.text): ([tuple(x) for x in r.runs], r.collapsed) for r in done.collect()}
    assert done.count() == len(rows)
    assert got[1, "x x x x x x y"] == ([(0, 6, 1)], "x y") and got[2, None] == ([], "") and got[3, ""] == ([], "")
    assert got[None, "a b " * 4] == ([(0, 8, 2)], "a b") and got[4, rows[5][1]] == ([], rows[5][1]) and got[5, "q " * 5] == ([], "q q q q q")
    assert periodic_runs.with_runs(df.limit(0)).count() == 0


def test_runs_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.QUERIES["op11_runs"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(rows) and sum(r.n_runs > 0 for r in got.values()) > 10
    for r in rows:
        words = (r.text or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            words = [words[i] if i < a else words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(n)]
        if n > 600:
            runs = periodic_runs.runs_of_texts([words])[0]
        else:
            runs = runs_by_brute_force(words)
        drop = {i for s, length, p in runs for i in range(s + p, s + length)}
        short = b" ".join(w for i, w in enumerate(words) if i not in drop)
        best = min(runs, key=lambda x: (-x[1] * 10**9 // x[2], x[0], x[2])) if runs else (None, None, None)
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert x.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % t for t in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(short).hexdigest()


# Pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids_of(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_pieces_equal_the_library(library):
    own, draw = piece_bpe.piece_codec(MODEL), random.Random(7)
    parts = [*"abcdefghijklmnop \n\t\x00é▁日本😀ꙮﷺ<>/s019.,'-=_()", "  ", "   ", "<s>", "</s>", "<unk>", "<0x0A>", "the", "ing", "‍", "\U0010ffff"]
    for n in range(6000):
        few = draw.sample(parts, draw.choice([1, 2, 5, len(parts)]))
        text = "".join(draw.choice(few) for _ in range(draw.randrange(40)))
        ids = library.encode(text)
        assert ids_of(own.encode(text)) == ids, text
        assert own.decode([1, *ids, 2]) == library.decode([1, *ids, 2])
        odd = [draw.randrange(32000) if draw.random() < 0.5 else draw.randrange(259) for _ in range(draw.randrange(12))]
        assert own.decode(odd) == library.decode(odd), odd


def test_compatible_pairs_are_encodings_of_their_texts(library):
    own, draw = piece_bpe.piece_codec(MODEL), random.Random(8)
    for _ in range(20_000):
        a, b = draw.randrange(len(own.text_of)), draw.randrange(len(own.text_of))
        text = own.text_of[a] + own.text_of[b]
        count, *_ = own.history(text)
        alone = own.history(own.text_of[a])[0] + own.history(own.text_of[b])[0]
        if count != alone:
            assert not own._is_compatible(b, a)


@pytest.mark.parametrize("text", ["a" * 200_000, "-=" * 100_000, " " * 200_000, "日" * 50_000, "ꙮ" * 50_000])
def test_long_unbroken_texts(library, text):
    assert ids_of(piece_bpe.piece_codec(MODEL).encode(text)) == library.encode(text)


def test_memo_is_bounded():
    held = Memo(len, entries=100, longest=10)
    assert [held["x" * 11], *(held[str(i)] for i in range(1000))] == [11, *(len(str(i)) for i in range(1000))]
    assert len(held) <= 100 and len(held.old) <= 100 and "x" * 11 not in held and held["999"] == 3


def test_pieces_edge_cases(spark, library):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "  x\u0000\ny ")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, ids string")
    done = piece_bpe.encode_and_decode(df, MODEL)
    assert done.columns == [*df.columns, "decoded"] and done.count() == len(rows)
    for r in done.collect():
        assert ids_of(r.ids) == [1, *library.encode(r.text or ""), 2] and r.decoded == (r.text or "")
    assert piece_bpe.encode_and_decode(df.limit(0), MODEL).count() == 0


def test_pieces_query(spark, sf_dir, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op12_pieces"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = [1, *library.encode(rows[r.doc_id] or ""), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
