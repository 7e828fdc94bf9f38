"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as a linked list of byte symbols with a heap of its adjacent pairs. The pair of
lowest rank is popped and merged until none is left; the count is the number of symbols minus the
number of merges. No identifiers are made.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import Memo, text_or_empty

#: Fixed value: the pre-token pattern of the byte-level library setting.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 31

_RUN = re.compile(r"\s\s")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Counter:
    """Counts tokens as the library does for a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as source:
            config = json.load(source)
        vocab, merges = config["model"]["vocab"], config["model"]["merges"]
        # A symbol is a byte, or 256 plus the rank of the merge that made it.
        symbol = {vocab[shown]: byte for byte, shown in byte_symbols().items()}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[symbol[vocab[a]] << 32 | symbol[vocab[b]]] = rank
            symbol.setdefault(vocab[a + b], 256 + rank)
        self.made = [symbol[vocab["".join(p.split(" ") if isinstance(p, str) else p)]] for p in merges]
        self.byte_rank = [self.rank.get(a << 32 | b, NONE) for a in range(256) for b in range(256)]
        special = sorted((t["content"] for t in config["added_tokens"]), key=len, reverse=True)
        self.split_special = re.compile("|".join(map(re.escape, special))).split if special else lambda t: [t]
        self.find_all = regex.compile(PATTERN).findall
        self._pieces = Memo(lambda piece: self.count_piece(piece.encode("utf-8")), entries=1 << 18)
        self._after_space = Memo(lambda chunk: self._count_pieces(" " + chunk), entries=1 << 18)

    def count_piece(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(piece)
        table, rank, made = self.byte_rank, self.rank.get, self.made
        # now[i]: rank of the pair that starts at symbol i; other heap entries of i are out of date.
        now = [table[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        heap = [r << 32 | i for i, r in enumerate(now) if r != NONE]
        if not heap:
            return n
        heapify(heap)
        now.append(NONE)
        symbol, after, before = list(piece), list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if now[i] != r:
                continue
            merges += 1
            j = after[i]
            now[j] = NONE
            new = symbol[i] = made[r]
            k, p = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                r = now[i] = rank(new << 32 | symbol[k], NONE)
                if r != NONE:
                    heappush(heap, r << 32 | i)
            else:
                now[i] = NONE
            if p >= 0:
                r = now[p] = rank(symbol[p] << 32 | new, NONE)
                if r != NONE:
                    heappush(heap, r << 32 | p)
        return n - merges

    def _count_pieces(self, text: str) -> int:
        return sum(map(self._pieces.__getitem__, self.find_all(text)))

    def _count_plain(self, text: str) -> int:
        if _RUN.search(text):
            return self._count_pieces(text)
        # Without two white-space characters in a row no pre-token reaches over a space.
        first, *rest = text.split(" ")
        return self._count_pieces(first) + sum(map(self._after_space.__getitem__, rest))

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token."""
        parts = self.split_special(text)
        return len(parts) - 1 + sum(map(self._count_plain, parts))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_column(text: Column, path: str) -> Column:
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for texts in batches:
            yield pd.Series([own.count(t or "") for t in texts], dtype="int64")

    return count(text)


def with_token_counts(
    df: DataFrame, path: str, limit: int = 512, text_col: str = "text", prefix: str = ""
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row.

    Rows are independent: repeated rows repeat their counts, a null or empty text counts 0, an
    empty table stays empty. Very long pre-tokens cost n log n. Columns that have these names
    already are replaced; ``prefix`` renames the new ones.
    """
    text = text_or_empty(text_col)
    counted = df.withColumns(
        {f"{prefix}n_bytes": F.octet_length(text).cast("long"), f"{prefix}n_tokens": count_column(text, path)}
    )
    return counted.withColumn(f"{prefix}over_limit", F.col(f"{prefix}n_tokens") > F.lit(limit))
