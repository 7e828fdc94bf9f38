"""Spelling variants by Bloom-guided neighbourhoods.

The vocabulary of a corpus is counted once. Its words are set in blocked Bloom filters, one shard per word
length: a word lies in one block of 512 bits, in which it sets six. A word's edits are generated as
hashes, not as texts: a polynomial hash of code points changes by one term for a replaced
code point and by a shift for a deleted one, so a whole neighbourhood takes a few array operations. Edits
whose bits are all set become texts and are shuffled to a join with the vocabulary, which removes the
false positives. As nearness is mutual, a word generates its deletions, which find the shorter words, and only
the replacements by a larger code point; insertions are the deletions of the longer word.

The filters travel in parts of bounded size, one after the other: a part is a range of blocks of one or
several lengths, and only words that may have an edit there probe it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import named, text_or_empty
from tarmac.session import cut_lineage

#: Letters of a word: the basic ones and code points 192 to 255.
LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Filter blocks of 64 bytes that are broadcast at once.
PART_BLOCKS = 1 << 19
BITS_PER_WORD, PROBES = 12, 6
#: Edits that a task holds at once.
EDITS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_ONE = np.uint64(1)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[_ONE], np.full(n, _BASE)]))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def code_points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length).astype(np.uint64)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    return (codes * _powers(codes.shape[1])[: codes.shape[1]]).sum(axis=1, dtype=np.uint64)


def blocks_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a mixed hash among ``blocks``."""
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def bits_of(h: np.ndarray, probe: int) -> np.ndarray:
    """Bit 0 to 511 of a block that a mixed hash sets with one of its probes."""
    again = (h * _BASE) >> np.uint64(10)
    return ((again >> np.uint64(9 * probe)) & np.uint64(511)).astype(np.int64)


class Part:
    """Filter blocks of some lengths: per length the number of all its blocks, the first one here, and the words of those here."""

    def __init__(self, shards: dict[int, tuple[int, int, int]]) -> None:
        #: length -> (blocks of the length, first block here, blocks here)
        self.shards = shards
        self.offset, at = {}, 0
        for length, (_, _, here) in shards.items():
            self.offset[length] = at
            at += here
        self.words = np.zeros((at, 8), dtype=np.uint64)

    def holds(self, length: int, h: np.ndarray) -> np.ndarray:
        """Positions of those hashes of edits of a length that the filter may hold."""
        if length not in self.shards:
            return np.empty(0, dtype=np.int64)
        blocks, first, here = self.shards[length]
        block = blocks_of(h, blocks) - first
        at = np.arange(len(h)) if here == blocks else np.flatnonzero((block >= 0) & (block < here))
        for probe in range(PROBES):
            bit = bits_of(h[at], probe)
            word = self.words[self.offset[length] + block[at], bit >> 6]
            at = at[(word >> (bit & 63).astype(np.uint64)) & _ONE == _ONE]
        return at


def edits(words: list[str], length: int, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Edits of words of one length, in slices: their length, mixed hashes, and the word, place and letter of each (0 for a deletion)."""
    power = _powers(length)
    places = max(1, EDITS // (len(letters) + 1))
    rows = max(1, places // length)
    for low in range(0, len(words), rows):
        codes = code_points(words[low : low + rows], length)
        terms = codes * power[:length]
        whole = terms.sum(axis=1, dtype=np.uint64)
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        after = np.zeros_like(codes)
        shifted = codes[:, 1:] * power[: length - 1]  # what follows a place, moved one place to the left
        after[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        for left in range(0, length, places):
            span = slice(left, left + places)
            own = codes[:, span]
            # Of equal letters in a row only the first is deleted: the results are equal.
            first = np.ones(own.shape, dtype=bool)
            first[:, 1:] = own[:, 1:] != own[:, :-1]
            if left:
                first[:, 0] = own[:, 0] != codes[:, left - 1]
            i, j = np.nonzero(first)
            yield length - 1, mixed(before[i, left + j] + after[i, left + j]), low + i, left + j, np.zeros(len(i), dtype=np.uint64)
            i, j, k = np.nonzero(letters[None, None, :] > own[:, :, None])
            yield length, mixed(whole[i] + (letters[k] - own[i, j]) * power[left + j]), low + i, left + j, letters[k]


def filter_rows(batches: Iterator[pd.DataFrame], blocks: dict[int, int]) -> Iterator[pd.DataFrame]:
    """(length, block, w0 … w7): the bits that a batch of words sets, block by block."""
    for batch in batches:
        for length, part in batch.groupby("length"):
            h = mixed(word_hashes(code_points(part["word"].to_list(), length)))
            block = blocks_of(h, blocks[length])
            at, own = np.unique(block, return_inverse=True)
            words = np.zeros((len(at), 8), dtype=np.uint64)
            for probe in range(PROBES):
                bit = bits_of(h, probe)
                np.bitwise_or.at(words, (own, bit >> 6), _ONE << (bit & 63).astype(np.uint64))
            yield pd.DataFrame({"length": np.int32(length), "block": at} | {f"w{i}": words[:, i].view(np.int64) for i in range(8)})


def plan_parts(blocks: dict[int, int], part_blocks: int) -> list[dict[int, tuple[int, int, int]]]:
    """Ranges of blocks, of ``part_blocks`` in all at most, that make up all lengths."""
    parts: list[dict[int, tuple[int, int, int]]] = [{}]
    room = part_blocks
    for length in sorted(blocks):
        first = 0
        while first < blocks[length]:
            if not room:
                parts.append({})
                room = part_blocks
            here = min(room, blocks[length] - first)
            parts[-1][length] = (blocks[length], first, here)
            first, room = first + here, room - here
    return parts


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, length, n) of every different ``word`` of that many code points and occurrences at least."""
    counted = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count).select("word", F.length("word").alias("length"), "n")


def near_pairs(vocab: DataFrame, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """(word, other, n, other_n), once per pair of words of ``vocab`` that differ by one inserted, deleted or replaced code point.

    ``vocab`` (word, length, n) holds each word once. The filters go through the driver in parts of
    ``part_blocks`` blocks (64 bytes each); their number grows with the vocabulary, and no part is left out.
    """
    spark = vocab.sparkSession
    sizes = {r["length"]: r["n"] for r in vocab.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    blocks = {length: max(1, math.ceil(n * BITS_PER_WORD / 512)) for length, n in sizes.items()}
    letters_seen = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    letters = np.array(sorted(ord(r["c"]) for r in letters_seen.where("c <> ''").collect()), dtype=np.uint64)  # an alphabet
    schema = "length int, block long, " + ", ".join(f"w{i} long" for i in range(8))
    set_bits = vocab.mapInPandas(lambda batches: filter_rows(batches, blocks), schema)
    set_bits = set_bits.groupBy("length", "block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
    set_bits = cut_lineage(set_bits)
    found = []
    for shards in plan_parts(blocks, part_blocks):
        if not shards:
            continue
        part = Part(shards)
        here = F.lit(False)
        for length, (_, first, n) in shards.items():
            here |= (F.col("length") == length) & F.col("block").between(first, first + n - 1)
        rows = set_bits.where(here).toPandas()  # part_blocks rows at most
        at = rows["block"].to_numpy() + rows["length"].map({k: part.offset[k] - shards[k][1] for k in shards}).to_numpy(dtype=np.int64)
        part.words[at] = rows[[f"w{i}" for i in range(8)]].to_numpy(dtype=np.int64).view(np.uint64)
        shared = spark.sparkContext.broadcast(part)
        asking = vocab.where(F.col("length").isin(sorted({x for k in shards for x in (k, k + 1)})))

        def probe(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = shared.value
            for batch in batches:
                for length, group in batch.groupby("length"):
                    words, counts = group["word"].to_list(), group["n"].to_numpy()
                    for edited, h, word, place, letter in edits(words, length, letters):
                        hit = own.holds(edited, h)
                        if len(hit):
                            texts = [words[w][:p] + (chr(c) if c else "") + words[w][p + 1 :] for w, p, c in zip(word[hit], place[hit], letter[hit], strict=True)]
                            yield pd.DataFrame({"other": texts, "word": [words[w] for w in word[hit]], "n": counts[word[hit]]})

        found.append(cut_lineage(asking.mapInPandas(probe, "other string, word string, n long")))
        shared.unpersist()
    if not found:
        return vocab.select("word", F.col("word").alias("other"), "n", F.col("n").alias("other_n")).limit(0)
    positives = found[0]
    for more in found[1:]:
        positives = positives.unionByName(more)
    return positives.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "other", "n", "other_n")


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form) that has a form: the last one reached.

    A form is more frequent than its word, so there are no circles; each round doubles the steps taken.
    """
    at = cut_lineage(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut_lineage(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def group_variants(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every different word of ``words`` (one row per occurrence, column ``word``).

    Words are those of ``min_length`` code points and ``min_count`` occurrences (``n``) at least. ``n_near``
    counts the words that differ by one inserted, deleted or replaced code point; ``form`` is the one of
    these with the largest ``n`` (ties: the smallest in code-point order), if that is ``ratio`` times
    the word's own or more, else null; ``root`` is reached by following forms, and is the word itself where it has none.
    Null words are passed over; other columns are not read; an empty table gives no rows. Very long words
    are edited in slices. ``ratio`` is 2 or more.
    """
    vocab = cut_lineage(vocabulary(words.select("word"), min_length, min_count))
    pairs = near_pairs(vocab, part_blocks)
    # Both ends of a pair, so that counts combine before the one shuffle.
    ends = F.array(
        F.struct(F.col("word").alias("word"), (-F.col("other_n")).alias("rank"), F.col("other").alias("near")),
        F.struct(F.col("other").alias("word"), (-F.col("n")).alias("rank"), F.col("word").alias("near")),
    )
    near = pairs.select(F.explode(ends).alias("e")).groupBy("e.word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct("e.rank", "e.near")).alias("best")
    )
    known = vocab.join(near, "word", "left")
    is_form = -F.col("best")["rank"] >= F.col("n") * ratio
    known = cut_lineage(
        known.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best")["near"]).alias("form"),
            F.when(is_form, -F.col("best")["rank"]).alias("form_n"),
        )
    )
    roots = with_roots(known)
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def letter_runs(text: Column, least: int = 1) -> Column:
    """The maximal runs of letters of a text, of ``least`` letters or more."""
    return F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))


def occurrences(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = MIN_LENGTH) -> DataFrame:
    """(id, word) per run of ``least`` or more letters of every whole text, A-Z in lower case; null texts have none."""
    lower = F.translate(text_or_empty(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.select(named(id_col).alias("id"), F.explode(letter_runs(lower, least)).alias("word"))
