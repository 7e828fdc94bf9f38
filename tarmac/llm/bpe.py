"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until its parts are small; parts are encoded apart and joined pairwise. Where a
cut lies at a pre-token border the join is a concatenation. Inside a pre-token the two token
lists are joined by encoding a window around the cut again. The window grows until both of its
borders are stable: a token list is the encoding of its bytes exactly when every adjacent pair of
tokens is the encoding of that pair's bytes, so tokens outside a window with stable borders
cannot change.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import Memo, scratch_name, text_or_empty
from tarmac.session import small_batches

LEAF_CHARS = 4096
LEAF_BYTES = 8
LEAF_TOKENS = 4096
#: Bytes from which a window is merged by a heap.
LONG = 48
#: Bytes of a batch of texts, about: texts, ids and decoded bytes are held together, several times over, beside the codec's tables.
BATCH_BYTES = 640_000

_RUN = re.compile(r"\s\s")
_BORDER = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder for one rank table. Encoded text is packed little-endian uint32."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.find_all = regex.compile(pattern).findall
        self._small = Memo(self.merge)
        self._stable = Memo(self._is_stable, longest=None)
        self._pieces = Memo(self._pack_piece)
        self._after_space = Memo(lambda chunk: self._pack_pieces(" " + chunk))

    # One pre-token.

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties; the leaf step of the tree."""
        if len(piece) >= LONG:
            return self._merge_by_heap(piece)
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _merge_by_heap(self, piece: bytes) -> list[int]:
        """``merge`` for long pieces: candidates wait in a heap, parts are linked by the places where they start."""
        rank, n = self.ranks.get, len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = ends[i]
            # Out of date when the part is gone or has grown, or its neighbour has.
            if middle == 0 or middle >= end or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := rank(piece[i : ends[end]])) is not None:
                    heappush(heap, (r, i, ends[end]))
            p = before[i]
            if p >= 0 and (r := rank(piece[p:end])) is not None:
                heappush(heap, (r, p, end))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : ends[at]]])
            at = ends[at]
        return out

    def _is_stable(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return self._small[self.bytes_of[a] + self.bytes_of[b]] == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of two encoded byte strings."""
        if not left or not right:
            return left or right
        stable = self._stable
        if stable[left[-1] << 32 | right[0]]:
            return left + right
        i, j, step = len(left) - 1, 1, 1
        while True:
            inside = b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j]))
            window = self._small[inside] if len(inside) <= 32 else self.merge(inside)
            left_ok = i == 0 or stable[left[i - 1] << 32 | window[0]]
            right_ok = j == len(right) or stable[window[-1] << 32 | right[j]]
            if left_ok and right_ok:
                return left[:i] + window + right[j:]
            i = i if left_ok else max(0, i - step)
            j = j if right_ok else min(len(right), j + step)
            step *= 2

    def tree(self, piece: bytes, done: dict[bytes, list[int]] | None = None) -> list[int]:
        """Halves apart, then joined; equal halves, as in runs of one byte, are encoded once."""
        if len(piece) <= LEAF_BYTES:
            return self._small[piece]
        done = {} if done is None else done
        if piece not in done:
            middle = len(piece) // 2
            done[piece] = self.join(self.tree(piece[:middle], done), self.tree(piece[middle:], done))
        return done[piece]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return self.tree(piece) if whole is None else [whole]

    # Whole texts.

    def _pack_piece(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece.encode("utf-8"))).tobytes()

    def _pack_pieces(self, text: str) -> bytes:
        return b"".join([self._pieces[p] for p in self.find_all(text)])

    def _leaf(self, text: str) -> bytes:
        if _RUN.search(text):
            return self._pack_pieces(text)
        # Without two white-space characters in a row no pre-token reaches over a space.
        first, *rest = text.split(" ")
        return self._pack_pieces(first) + b"".join(map(self._after_space.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if len(text) <= LEAF_CHARS:
            return self._leaf(text)
        middle = len(text) // 2
        found = _BORDER.search(text, middle)
        at = found.start() if found else text.rfind(" ", 0, middle)
        while found is None and at > 0 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.rfind(" ", 0, at)
        if at <= 0:  # one unbroken run: the tree goes on inside its pre-tokens
            return self._leaf(text)
        # A single space between two others starts a pre-token: nothing outside can change.
        return self.encode(text[:at]) + self.encode(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """Token ids of a text as packed little-endian uint32; null counts as empty."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for texts in batches:
            yield pd.Series([own.encode(t or "") for t in texts], dtype=object)

    return encode(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that packed token ids stand for; null counts as no ids."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for packed in batches:
            yield pd.Series([own.decode(np.frombuffer(p or b"", dtype="<u4").tolist()) for p in packed], dtype=object)

    return decode(ids)


def round_trip_column(text: Column, path: str, pattern: str) -> Column:
    """Struct of ``ids`` and of the ``decoded`` bytes of those ids, in one pass over the texts."""

    @F.pandas_udf("ids binary, decoded binary")
    def round_trip(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for texts in batches:
            ids = [own.encode(t or "") for t in texts]
            decoded = [own.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(decoded, dtype=object)})

    return round_trip(text)


def encode_texts(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids of every text.

    Each match of ``pattern`` is encoded by itself with the ranks at ``path``; special tokens are
    ordinary text. Rows are independent: repeated rows repeat their ids, a null or empty text has
    none, an empty table stays empty. Very long texts and very long pre-tokens cost n log n. A
    column that is named ``ids_col`` already is replaced; all others are kept.
    """
    return df.withColumn(ids_col, encode_column(text_or_empty(text_col), path, pattern))


def decode_ids(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes of packed token ids; the inverse of ``encode_texts``. Null ids give no bytes."""
    return df.withColumn(out_col, decode_column(F.col(ids_col), path, pattern))


def encode_and_decode(
    df: DataFrame,
    path: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "ids",
    out_col: str = "decoded",
) -> DataFrame:
    """``encode_texts`` and ``decode_ids`` in one pass: a task keeps one worker and sends no ids back and forth."""
    small_batches(df.sparkSession, size=BATCH_BYTES)
    both = scratch_name(df, "_both")
    done = df.withColumn(both, round_trip_column(text_or_empty(text_col), path, pattern))
    return done.withColumns({ids_col: F.col(both)["ids"], out_col: F.col(both)["decoded"]}).drop(both)
