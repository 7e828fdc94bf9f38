"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarmac.llm import queries, spelling


def by_brute_force(counts, ratio=10):
    """(word, n, n_near, form, form_n, root) from the counts of a vocabulary: words meet under a pattern with a gap."""
    slots = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            slots[w[:i] + "\0" + w[i + 1 :]].add(w)  # replaced
            slots[w[:i] + w[i + 1 :], len(w)].add(w)  # deleted
    near = defaultdict(set)
    for key, words in slots.items():
        if isinstance(key, str):
            for w in words:
                near[w] |= words - {w}
        elif key[0] in counts:
            for w in words:
                near[w].add(key[0])
                near[key[0]].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return rows


def as_rows(df):
    return [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]


def words_at_random(draw, letters, lengths, n):
    words = ["".join(draw.choice(letters) for _ in range(draw.choice(lengths))) for _ in range(n)]
    counts = Counter({w: draw.choice([2, 3, 20, 200, 2000]) for w in words})
    for w in words[: n // 3]:
        i = draw.randrange(len(w))
        for other in (w[:i] + w[i + 1 :], w[:i] + draw.choice(letters) + w[i:], w[:i] + draw.choice(letters) + w[i + 1 :]):
            counts[other] = draw.choice([2, 5, 50])
    return {w: n for w, n in counts.items() if len(w) >= 3}


@pytest.mark.parametrize(("letters", "lengths", "part_blocks"), [("ab", [3, 4, 5, 6], 1), ("abcdeéÿz", [5, 7, 8], 2), ("xyz", [12, 40], 1 << 19)])
def test_variants_of_random_vocabularies(spark, letters, lengths, part_blocks):
    draw = random.Random(len(letters))
    counts = words_at_random(draw, letters, lengths, 150)
    rows = [(w,) for w, n in counts.items() for _ in range(min(n, 50))]
    counts = {w: min(n, 50) for w, n in counts.items()}
    df = spark.createDataFrame(rows, "word string").repartition(3)
    got = as_rows(spelling.group_variants(df, min_length=3, ratio=5, part_blocks=part_blocks))
    assert len(got) == len(counts) and set(got) == by_brute_force(counts, ratio=5)


def test_edits_hash_as_their_texts(monkeypatch):
    draw = random.Random(2)
    words = ["".join(draw.choice("abß") for _ in range(9)) for _ in range(50)]
    letters = np.array(sorted(map(ord, "abß")), dtype=np.uint64)
    for at_once in (1 << 20, 8):
        monkeypatch.setattr(spelling, "EDITS", at_once)
        seen = defaultdict(set)
        for length, h, word, place, letter in spelling.edits(words, 9, letters):
            texts = [words[w][:p] + (chr(c) if c else "") + words[w][p + 1 :] for w, p, c in zip(word, place, letter, strict=True)]
            assert {len(t) for t in texts} <= {length}
            if texts:
                assert (spelling.mixed(spelling.word_hashes(spelling.code_points(texts, length))) == h).all()
            for w, t in zip(word.tolist(), texts, strict=True):
                assert t not in seen[w]
                seen[w].add(t)
        for w, text in enumerate(words):
            deleted = {text[:i] + text[i + 1 :] for i in range(9)}
            larger = {text[:i] + c + text[i + 1 :] for i in range(9) for c in "abß" if c > text[i]}
            assert seen[w] == deleted | larger


def test_parts_cover_all_blocks():
    parts = spelling.plan_parts({7: 5, 8: 12, 9: 1}, 4)
    assert all(sum(here for _, _, here in p.values()) <= 4 for p in parts)
    held = Counter((k, b) for p in parts for k, (_, first, here) in p.items() for b in range(first, first + here))
    assert held == Counter((k, b) for k, n in {7: 5, 8: 12, 9: 1}.items() for b in range(n))


def test_filters_hold_their_words_and_few_others():
    draw = random.Random(3)
    words = sorted({"".join(draw.choice("abcdefghij") for _ in range(8)) for _ in range(20_000)})
    import pandas as pd

    blocks = {8: len(words) * spelling.BITS_PER_WORD // 512}
    (rows,) = spelling.filter_rows(iter([pd.DataFrame({"word": words, "length": 8})]), blocks)
    part = spelling.Part({8: (blocks[8], 0, blocks[8])})
    part.words[rows["block"]] = rows[[f"w{i}" for i in range(8)]].to_numpy().view(np.uint64)
    assert len(part.holds(8, spelling.mixed(spelling.word_hashes(spelling.code_points(words, 8))))) == len(words)
    others = sorted({"".join(draw.choice("abcdefghij") for _ in range(8)) for _ in range(20_000)} - set(words))
    assert len(part.holds(8, spelling.mixed(spelling.word_hashes(spelling.code_points(others, 8))))) < 0.03 * len(others)


def test_variant_edge_cases(spark):
    long = "abcdefghij" * 2000
    words = ["colours"] * 20 + ["colour"] * 9 + ["colourz"] * 2 + ["colourzz"] * 2 + ["unique"] + [None, ""] + [long] * 20 + [long[:-1]] * 2 + ["éÿxxxxx"] * 2
    df = spark.createDataFrame([(w, "k", 1, "f") for w in words], "word string, other string, n int, form string")
    got = {r[0]: r[1:] for r in as_rows(spelling.group_variants(df))}
    assert got == {
        "colours": (20, 1, None, None, "colours"),
        "colourz": (2, 2, "colours", 20, "colours"),
        "colourzz": (2, 1, None, None, "colourzz"),
        long: (20, 1, None, None, long),
        long[:-1]: (2, 1, long, 20, long),
        "éÿxxxxx": (2, 0, None, None, "éÿxxxxx"),
    }
    assert spelling.group_variants(df.limit(0)).count() == 0
    chain = [w for w, n in (("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000)) for _ in range(n)]
    assert {r[0]: r[5] for r in as_rows(spelling.group_variants(spark.createDataFrame([(w,) for w in chain], "word string")))} == dict.fromkeys(chain, "aaaabbb")


def test_variants_query(spark, sf_dir):
    counts = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = as_rows(queries.QUERIES["op13_spelling"](spark, sf_dir))
    assert len(got) == len(counts) and set(got) == by_brute_force(counts)
    assert any(r[3] for r in got)
