"""Document fingerprints by order MinHash.

The character k-mers of a text are numbered by occurrence, so a repeated k-mer gives distinct items.
A hash deals the items to bins; in each bin the smallest few are selected and their hashes, in the order in
which they stand in the text, are hashed together. Texts agree in a bin only when they share the
selected k-mers in the same order, so likeness falls with edit distance, not only with overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import named, text_or_empty

KMER, BINS, PICKED = 6, 128, 2
SEED = 42
#: Items kept per bin on average before the smallest are looked for; too few in a bin: all are.
_SHORTLIST = 16
#: Bits in which a place fits beside a k-mer's hash; longer texts sort the two apart.
_PLACE_BITS = np.uint64(24)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _items(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every occurrence-numbered k-mer; a shorter text is one k-mer."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    k = min(KMER, len(codes))
    n = len(codes) - k + 1
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(0x100000001B3) + codes[i : i + n] + np.uint64(SEED)
    kmer = _mix(rolled) >> _PLACE_BITS
    # Equal k-mers become neighbours, in text order.
    if n <= 1 << int(_PLACE_BITS):
        ordered = np.sort((kmer << _PLACE_BITS) | np.arange(n, dtype=np.uint64))
        kmer, place = ordered >> _PLACE_BITS, ordered & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))
    else:
        place = np.argsort(kmer, kind="stable").astype(np.uint64)
        kmer = kmer[place]
    at = np.arange(n)
    starts = np.concatenate([[True], kmer[1:] != kmer[:-1]])
    occurrence = at - np.maximum.accumulate(np.where(starts, at, 0))
    return _mix(kmer * np.uint64(0x9E3779B97F4A7C15) + occurrence.astype(np.uint64)), place


def signature(text: str) -> np.ndarray:
    """``BINS`` 16-bit numbers, 0 for a bin without items; all 0 for an empty text."""
    out = np.zeros(BINS, dtype=np.uint16)
    if not text:
        return out
    item, place = _items(text)
    bits = np.uint64(BINS.bit_length() - 1)
    low_bits = np.uint64(64) - bits
    keys = (item << low_bits) | (item >> bits)  # the bin, then the rank in it
    if len(keys) > BINS * _SHORTLIST:
        limit = np.uint64(int(BINS * _SHORTLIST / len(keys) * 2.0 ** int(low_bits)))
        short = np.flatnonzero(item >> bits < limit)
        counts = np.bincount((keys[short] >> low_bits).astype(np.int64), minlength=BINS)
        if counts.min() >= PICKED:
            keys, place = keys[short], place[short]
    order = np.argsort(keys)
    keys, place = keys[order], place[order]
    bins = (keys >> low_bits).astype(np.int64)
    start = np.searchsorted(bins, np.arange(BINS + 1))
    counts = np.minimum(np.diff(start), PICKED)
    chosen = np.minimum(start[:-1, None] + np.arange(PICKED), len(keys) - 1)
    absent = np.arange(PICKED) >= counts[:, None]
    places = np.where(absent, np.uint64(1 << 63), place[chosen])
    by_place = np.argsort(places, axis=1, kind="stable")
    hashes = np.take_along_axis(np.where(absent, np.uint64(0), keys[chosen] | np.uint64(1)), by_place, axis=1)
    tuples = np.zeros(BINS, dtype=np.uint64)
    for i in range(PICKED):
        tuples = _mix(tuples * np.uint64(31) + hashes[:, i])
    found = np.maximum((tuples >> np.uint64(48)).astype(np.uint16), np.uint16(1))
    out[counts > 0] = found[counts > 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either text fills; 1 for two empty texts."""
    filled = (a != 0) | (b != 0)
    return float((a[filled] == b[filled]).mean()) if filled.any() else 1.0


def to_hex(signature_: np.ndarray) -> str:
    return signature_.astype(">u2").tobytes().hex()


def signature_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([to_hex(signature(t or "")) for t in texts], dtype=object)

    return fingerprint(text)


def with_fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text: ``BINS`` numbers of 4 hex digits.

    Equal texts have equal fingerprints; null counts as empty, whose fingerprint is all zeros.
    Empty tables stay empty. A column named ``out_col`` already is replaced.
    """
    return df.withColumn(out_col, signature_column(text_or_empty(text_col)))
