"""Periodic runs of words by descending-LCP Kruskal.

The suffixes of a text's words are sorted, with the lengths of the longest common prefixes (LCP) of
neighbours. Classes of suffixes are united by decreasing LCP, with union-find; each class keeps its
positions in order. When two classes unite at length ``l``, positions ``i < j`` of different
origin that become adjacent agree in exactly ``l`` words. If ``j - i <= l`` they seed a repetition
with period ``j - i`` and length ``j - i + l``, which cannot go on to the right; a position between them
with a smaller period would have been united earlier. Each run is seeded once at its first word,
so seeds that go on to the left are passed over.

Many texts are sorted together: words of different texts never have equal numbers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import scratch_name, text_or_empty

MIN_EXPONENT, MIN_WORDS = 4, 6
#: Words that are sorted together, unless one text alone has more.
TOGETHER = 200_000
_BLOCK = 512


class Positions:
    """Positions in order, in blocks, so that an insertion costs a block at most."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, position: int) -> None:
        self.blocks, self.firsts, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> None:
        at = max(0, bisect_right(self.firsts, x) - 1)
        block = self.blocks[at]
        if x > block[-1]:
            block.append(x)
        else:
            insort(block, x)
            self.firsts[at] = block[0]
        self.size += 1
        if len(block) > 2 * _BLOCK:
            self.blocks[at : at + 1] = [block[:_BLOCK], block[_BLOCK:]]
            self.firsts[at : at + 1] = [block[0], block[_BLOCK]]

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The positions before and after ``x``, which is present."""
        at = bisect_right(self.firsts, x) - 1
        block = self.blocks[at]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.blocks[at - 1][-1] if at else None
        after = block[i + 1] if i + 1 < len(block) else self.firsts[at + 1] if at + 1 < len(self.firsts) else None
        return before, after


def suffix_order(symbols: np.ndarray, least: int) -> np.ndarray:
    """Suffixes that share ``least`` or more symbols with another, in the order of suffixes, by doubling.

    Symbols are dense numbers; the last one, and every one that ends a text, occurs once.
    Suffixes of one class of the first ``least`` symbols or fewer stand together.
    """
    counts = np.bincount(symbols)
    rank = (np.cumsum(counts) - counts)[symbols].astype(np.int64)
    active = np.flatnonzero(counts[symbols] > 1)
    kept = active
    length = 1
    while len(active):
        if length <= least:
            kept = active
        key = rank[active] << 32 | rank[active + length]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        at = np.arange(len(active))
        old = np.flatnonzero(np.diff(key >> 32, prepend=-1))
        new = np.flatnonzero(np.diff(key, prepend=-1))
        first = np.zeros(len(active), dtype=np.int64)
        first[new] = new
        np.maximum.accumulate(first, out=first)
        group = np.zeros(len(active), dtype=np.int64)
        group[old] = old
        np.maximum.accumulate(group, out=group)
        rank[active] = (key >> 32) + first - group
        sizes = np.diff(np.append(new, len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        length *= 2
    if length <= least:
        kept = active
    return kept[np.argsort(rank[kept], kind="stable")]


def common_prefixes(symbols: list[int], order: np.ndarray, least: int) -> list[int]:
    """Per suffix of ``order``, the symbols it shares with the one before it; 0 for the first.

    Next in the text, a suffix shares one symbol less at least, as long as that is ``least`` or more.
    """
    before = dict(zip(order[1:].tolist(), order[:-1].tolist(), strict=True))
    found: dict[int, int] = {}
    last, h = -2, 0
    for i in sorted(before):
        h = h - 1 if i == last + 1 and h > least else 0
        j = before[i]
        while symbols[i + h] == symbols[j + h]:
            h += 1
        found[i] = h
        last = i
    return [found.get(i, 0) for i in order.tolist()]


def runs_of(symbols: np.ndarray, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``min_words`` symbols and ``min_exponent`` periods.

    ``symbols`` as for ``suffix_order``; the exponent is 2 at least.
    """
    # A run of period p has its first two periods' starts agree in this many symbols or more, over all p.
    least = max(1, min(max(min_exponent * p, min_words) - p for p in range(1, max(2, min_words) + 1)))
    order = suffix_order(symbols, least)
    if len(order) < 2:
        return []
    words = symbols.tolist()
    shared = common_prefixes(words, order, least)
    places = order.tolist()
    sets: list[Positions | None] = [None] * len(places)
    parent = list(range(len(places)))

    def find(n: int) -> int:
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    found = []
    lengths = np.array(shared)
    edges = np.flatnonzero(lengths >= least)
    for edge in edges[np.argsort(-lengths[edges], kind="stable")].tolist():
        length = shared[edge]
        a, b = find(edge - 1), find(edge)
        for n in (a, b):
            if sets[n] is None:
                sets[n] = Positions(places[n])
        if sets[a].size < sets[b].size:
            a, b = b, a
        big, small = sets[a], list(sets[b])
        parent[b], sets[b] = a, None
        for x in small:
            big.add(x)
        for at, x in enumerate(small):
            before, after = big.around(x)
            pairs = []
            if before is not None and (at == 0 or before != small[at - 1]):
                pairs.append((before, x))
            if after is not None and (at + 1 == len(small) or after != small[at + 1]):
                pairs.append((x, after))
            for i, j in pairs:
                period = j - i
                if period > length or period + length < max(min_words, min_exponent * period):
                    continue
                if i == 0 or words[i - 1] != words[j - 1]:
                    found.append((i, period + length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: Iterable[list[bytes]], min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """Per text, given as its words, the runs by start and period."""
    symbols: list[int] = []
    starts = []
    base = 0
    for words in texts:
        starts.append(len(symbols))
        number: dict[bytes, int] = {}
        symbols.extend([base + number.setdefault(w, len(number)) for w in words])
        base += len(number)
        symbols.append(base)
        base += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in starts]
    for start, length, period in runs_of(np.array(symbols, dtype=np.int64), min_exponent, min_words):
        n = bisect_right(starts, start) - 1
        out[n].append((start - starts[n], length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stand in no run after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def _groups(texts: Iterable[str | None]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        words = (text or "").encode("utf-8").split()
        if held and size + len(words) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words) + 1
    if held:
        yield held


def runs_column(text: Column, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> Column:
    """Struct of a text's ``runs`` and of its ``collapsed`` text."""

    @F.pandas_udf("runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, short = [], []
            for group in _groups(batch):
                for words, runs in zip(group, runs_of_texts(group, min_exponent, min_words), strict=True):
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    short.append(collapsed(words, runs).decode("utf-8"))
            yield pd.DataFrame({"runs": pd.Series(found, dtype=object), "collapsed": pd.Series(short, dtype=object)})

    return detect(text)


def with_runs(
    df: DataFrame,
    text_col: str = "text",
    runs_col: str = "runs",
    collapsed_col: str = "collapsed",
    min_exponent: int = MIN_EXPONENT,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Add every text's periodic runs and its text without their repetitions.

    Words are runs of characters other than space and the control characters 9 to 13, numbered from
    0. A run is a stretch (start, length, period in words) with smallest period ``period``, of at
    least ``min_words`` words and ``min_exponent`` (2 or more) periods, that no neighbouring word extends. Runs
    come by start, then period, without a cap. The collapsed text keeps the words that stand in no run after its first
    period, joined by one space. Rows are independent: repeated rows repeat their runs, a null or
    empty text has none and collapses to an empty text, an empty table stays empty. Very long texts and runs cost
    about n log n. Columns named ``runs_col`` or ``collapsed_col`` are replaced, others kept.
    """
    both = scratch_name(df, "_both")
    done = df.withColumn(both, runs_column(text_or_empty(text_col), min_exponent, min_words))
    return done.withColumns({runs_col: F.col(both)["runs"], collapsed_col: F.col(both)["collapsed"]}).drop(both)
