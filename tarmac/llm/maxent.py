"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

P(token | context) = P(class | context) * P(token | class). The class is a softmax over hashed
features of the context: the token before, the two before (n-grams), and the ones two and three
back (skips). Weights are trained by gradient steps in tasks whose updates are averaged.

Documents are read once into packs: token streams over a small vocabulary of their own, in packed columns.
Whatever concerns a word travels once per pack rather than once per document, so frequent words
are not hot keys. Counts of all words come back to the packs by a join, one pack is scored at a time, and scores are
sums over arrays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import named, text_or_empty
from tarmac.session import cut_lineage, small_batches

#: Tokens of a pack, about (one document at least).
PACK_TOKENS = 2_000_000
#: Frequent words with a context bucket of their own, and buckets for the endings of all others.
HEAD, TAILS = 2048, 2048
BUCKETS = HEAD + TAILS
START = BUCKETS  # stands before a document's first token
CLASSES, ANCHORS = 32, 64
PAIRS = 1 << 15  # slots for the hashed pair of the two tokens before
ROUNDS, BATCH, RATE = 2, 8192, 0.3
#: Tokens whose context is held at once.
SLICE = BATCH * 16
_TABLES = (1, BUCKETS + 1, BUCKETS + 1, BUCKETS + 1, PAIRS)
_FIRST = np.concatenate([[0], np.cumsum(_TABLES)])
SLOTS = int(_FIRST[-1])
#: Slots whose updates travel as one row.
SLOT_BLOCK = 1024
END = xxhash.xxh64_intdigest(b"", 0)  # no word is empty

PACK = (
    "ids array<string>, held array<boolean>, lengths array<int>, low binary, high binary, "
    "vocab binary, tails binary, counts binary"
)


# Packs.


class _Builder:
    def __init__(self) -> None:
        self.ids: list[str | None] = []
        self.held: list[bool] = []
        self.streams: list[np.ndarray] = []
        self.index: dict[bytes, int] = defaultdict(count().__next__)
        self.tokens = 0
        self.index[b""]  # the end token

    def add(self, doc_id: str | None, held: bool, text: str) -> None:
        words = text.encode("utf-8").lower().split()
        words.append(b"")
        self.streams.append(np.fromiter(map(self.index.__getitem__, words), dtype=np.uint32, count=len(words)))
        self.ids.append(doc_id)
        self.held.append(held)
        self.tokens += len(words)

    def row(self) -> pd.DataFrame:
        lengths = [len(s) for s in self.streams]
        n = len(self.index)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in self.index), dtype=np.uint64, count=n)
        tails = np.fromiter((xxhash.xxh32_intdigest(w[-3:], 0) for w in self.index), dtype=np.uint32, count=n) % np.uint32(TAILS)
        self.index.clear()  # a pack is built once: its words go before its arrays double
        stream = np.concatenate(self.streams)
        self.streams.clear()
        trained = stream[np.repeat(~np.array(self.held), lengths)]
        counts = np.zeros(n, dtype="<u4")
        for at in range(0, len(trained), SLICE):
            counts += np.bincount(trained[at : at + SLICE], minlength=n).astype("<u4")
        return pd.DataFrame(
            {
                "ids": [self.ids],
                "held": [self.held],
                "lengths": [lengths],
                "low": [(stream & np.uint32(0xFFFF)).astype("<u2").tobytes()],
                "high": [(stream >> np.uint32(16)).astype("<u2").tobytes()],
                "vocab": [hashes.astype("<u8").tobytes()],
                "tails": [tails.astype("<u2").tobytes()],
                "counts": [counts.tobytes()],
            }
        )


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = _Builder()
    for batch in batches:
        for doc_id, held, text in zip(batch["id"], batch["held"], batch["text"], strict=True):
            pack.add(doc_id, bool(held), text)
            if pack.tokens >= PACK_TOKENS:
                yield pack.row()
                pack = _Builder()
    if pack.ids:
        yield pack.row()


def pack_documents(df: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """Packs of whole documents, written once; ``held_out`` marks the ones that nothing is learned from."""
    rows = df.select(
        named(id_col).cast("string").alias("id"), held_out.alias("held"), text_or_empty(text_col).alias("text")
    )
    return cut_lineage(rows.mapInPandas(_build, PACK).withColumn("pack", F.monotonically_increasing_id()))


@dataclass
class Pack:
    """A pack's arrays: stream of local words, their hashes and ending buckets, document limits."""

    stream: np.ndarray
    vocab: np.ndarray
    tails: np.ndarray
    lengths: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, row) -> Pack:
        stream = np.frombuffer(row.high, "<u2").astype(np.int32)
        stream <<= 16
        stream |= np.frombuffer(row.low, "<u2")
        return cls(
            stream,
            np.frombuffer(row.vocab, "<u8"),
            np.frombuffer(row.tails, "<u2").astype(np.int64),
            np.asarray(row.lengths, dtype=np.int64),
            np.asarray(row.held, dtype=bool),
        )

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)

    def buckets(self, head: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Context bucket per local word; ``head`` are sorted hashes, ``rank`` their buckets."""
        out = HEAD + self.tails
        if len(head):
            at = np.minimum(np.searchsorted(head, self.vocab), len(head) - 1)
            known = head[at] == self.vocab
            out[known] = rank[at[known]]
        return out.astype(np.int16)


def _back(values: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """Each value's predecessor ``steps`` back in its document, or START."""
    out = np.full(len(values), START, dtype=np.int64)
    out[steps:] = values[:-steps] if steps else values
    for k in range(steps):
        at = starts + k
        out[at[at < len(values)]] = START  # a shorter document's places are its successor's starts
    return out


def _part(values: np.ndarray, at: int, size: int) -> tuple[np.ndarray, int]:
    """``size`` values from ``at`` on, behind the (up to three) before them, so slices do not change features; how many those are."""
    low = max(0, at - 3)
    return values[low : at + size], at - low


def _within(starts: np.ndarray, low: int, size: int) -> np.ndarray:
    """The document starts inside a slice, counted from the slice's own."""
    return starts[np.searchsorted(starts, low) : np.searchsorted(starts, low + size)] - low


def context_slots(buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weight rows of every token's context features: (tokens, features)."""
    one, two, three = (_back(buckets, starts, k) for k in (1, 2, 3))
    mixed = (one * np.int64(BUCKETS + 1) + two).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    pair = (mixed >> np.uint64(49)).astype(np.int64)  # 15 bits: PAIRS slots
    return np.stack([np.zeros_like(one), one, two, three, pair], axis=1) + _FIRST[:-1]


def log_softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def class_logits(weights: np.ndarray, slots: np.ndarray) -> np.ndarray:
    total = weights[slots[:, 0]]
    for f in range(1, slots.shape[1]):
        total += weights[slots[:, f]]
    return total


# Training.


@dataclass
class Model:
    """Everything that scoring needs; its size depends on the settings above, not on the data."""

    head: np.ndarray  # sorted hashes of the frequent words
    rank: np.ndarray  # their buckets
    class_of: np.ndarray  # class per bucket
    weights: np.ndarray  # (SLOTS, CLASSES)
    class_log_total: np.ndarray  # log10 of each class's weight
    class_log_unknown: np.ndarray  # log10 of the weight of its unknown words
    tokens: int
    base_log_total: float


def _cooccurrence(packs: Iterator[pd.DataFrame], head: np.ndarray, rank: np.ndarray) -> Iterator[pd.DataFrame]:
    """Counts of (anchor word one or two before, bucket) in training documents."""
    total = np.zeros(ANCHORS * BUCKETS, dtype=np.int64)
    for batch in packs:
        for row in batch.itertuples():
            pack = Pack.of(row)
            buckets = pack.buckets(head, rank)[pack.stream]
            starts, trained = pack.starts(), np.repeat(~pack.held, pack.lengths)
            for at in range(0, len(buckets), SLICE):
                part, skip = _part(buckets, at, SLICE)
                inside = _within(starts, at - skip, len(part))
                for steps in (1, 2):
                    before = _back(part, inside, steps)[skip:]
                    use = trained[at : at + SLICE] & (before < ANCHORS)
                    total += np.bincount(before[use] * BUCKETS + part[skip:][use], minlength=len(total))
    cells = np.flatnonzero(total)
    yield pd.DataFrame({"cell": cells, "n": total[cells]})


def word_classes(together: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A class per bucket: k-means on how much more often than expected each anchor stands before it."""
    expected = together.sum(axis=1, keepdims=True) * (together.sum(axis=0) / max(1, together.sum()))
    profile = np.log((together + 1.0) / (expected + 1.0)).T
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    weight = np.maximum(counts, 1e-9)
    by_count = np.argsort(-counts, kind="stable")
    centres = profile[by_count[:: max(1, len(by_count) // 4 // CLASSES)][:CLASSES]].copy()
    chosen = np.arange(len(profile)) % CLASSES
    for _ in range(20):
        near = profile @ centres.T
        chosen = np.where(np.abs(profile).sum(axis=1) > 0, near.argmax(axis=1), np.arange(len(profile)) % CLASSES)
        for c in range(CLASSES):
            own = chosen == c
            if own.any():
                mean = (profile[own] * weight[own, None]).sum(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-9)
    return chosen.astype(np.int64)


def _descend(packs: Iterator[pd.DataFrame], head, rank, class_of, weights) -> Iterator[pd.DataFrame]:
    """Gradient steps over a task's packs from the shared weights; returns its updates by block of slots."""
    own = weights.copy()
    squares = np.full(own.shape, 1.0, dtype=np.float32)
    tokens = 0
    for batch in packs:
        for row in batch.itertuples():
            pack = Pack.of(row)
            buckets = pack.buckets(head, rank)[pack.stream]
            starts, trained = pack.starts(), np.repeat(~pack.held, pack.lengths)
            for at in range(0, len(buckets), SLICE):
                part, skip = _part(buckets, at, SLICE)
                slots = context_slots(part, _within(starts, at - skip, len(part)))[skip:]
                target = class_of[part[skip:]]
                use = trained[at : at + SLICE]
                slots, target = slots[use], target[use]
                for i in range(0, len(target), BATCH):
                    _step(own, squares, slots[i : i + BATCH], target[i : i + BATCH])
                tokens += len(target)
    if tokens:
        change = (own - weights).astype("<f2")
        for block in range(-(-SLOTS // SLOT_BLOCK)):
            part = change[block * SLOT_BLOCK : (block + 1) * SLOT_BLOCK]
            if part.any():
                yield pd.DataFrame({"block": [block], "tokens": [tokens], "change": [part.tobytes()]})
        yield pd.DataFrame({"block": [-1], "tokens": [tokens], "change": [b""]})


def _step(weights: np.ndarray, squares: np.ndarray, slots: np.ndarray, target: np.ndarray) -> None:
    gradient = np.exp(log_softmax(class_logits(weights, slots)))
    gradient[np.arange(len(target)), target] -= 1.0
    for f in range(slots.shape[1]):
        order = np.argsort(slots[:, f].astype(np.uint16 if SLOTS < 1 << 16 else np.int64), kind="stable")
        rows = slots[order, f]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        summed = np.add.reduceat(gradient[order], first, axis=0)
        rows = rows[first]
        squares[rows] += summed * summed
        weights[rows] -= RATE * summed / np.sqrt(squares[rows])


def _merge(parts: pd.DataFrame) -> pd.DataFrame:
    block = int(parts["block"].iloc[0])
    total = None
    for tokens, change in zip(parts["tokens"], parts["change"], strict=True):
        values = np.frombuffer(change, "<f2").astype(np.float64) * tokens
        total = values if total is None else total + values
    return pd.DataFrame({"block": [block], "tokens": [int(parts["tokens"].sum())], "change": [total.astype("<f8").tobytes()]})


_CHANGE = "block int, tokens long, change binary"


def word_counts(packs: DataFrame) -> DataFrame:
    """(hash, tail, n) over all training documents: one row per word of a pack before the shuffle."""

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for vocab, tails, counts in zip(batch["vocab"], batch["tails"], batch["counts"], strict=True):
                n = np.frombuffer(counts, "<u4").astype(np.int64)
                some = n > 0
                yield pd.DataFrame(
                    {"hash": np.frombuffer(vocab, "<i8")[some], "tail": np.frombuffer(tails, "<u2")[some].astype(np.int32), "n": n[some]}
                )

    rows = packs.select("vocab", "tails", "counts").mapInPandas(unfold, "hash long, tail int, n long")
    return rows.groupBy("hash", "tail").agg(F.sum("n").alias("n"))


def train(packs: DataFrame, counts: DataFrame) -> Model:
    """Fit to the training documents of all packs. Only tables of fixed size reach the driver."""
    top = counts.orderBy(F.desc("n"), "hash").limit(HEAD).collect()
    hashes = np.array([r["hash"] for r in top], dtype=np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    head, rank = hashes[by_hash], by_hash.astype(np.int64)

    totals = np.zeros((4, BUCKETS))  # tokens, words, words seen once, all by bucket
    by_tail = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("once"))
    for r in by_tail.collect():
        totals[:3, HEAD + r["tail"]] = r["n"], r["v"], r["once"]
    for i, r in enumerate(top):
        own = np.array([r["n"], 1, r["n"] == 1], dtype=float)
        totals[:3, i] = own
        totals[:3, HEAD + r["tail"]] -= own

    narrow = packs.select("held", "lengths", "low", "high", "vocab", "tails")
    cells = narrow.mapInPandas(lambda b: _cooccurrence(b, head, rank), "cell int, n long")
    together = np.zeros(ANCHORS * BUCKETS)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        together[r["cell"]] = r["n"]
    class_of = word_classes(together.reshape(ANCHORS, BUCKETS), totals[0])

    per_class = np.stack([np.bincount(class_of, totals[k], CLASSES) for k in range(3)])
    unknown = np.maximum(per_class[2], 0.5)
    class_total = per_class[0] + 0.5 * per_class[1] + unknown
    weights = np.zeros((SLOTS, CLASSES), dtype=np.float32)
    weights[0] = np.log((per_class[0] + 1.0) / (per_class[0].sum() + CLASSES))
    for r in range(ROUNDS):
        now = weights
        part = packs.where(F.pmod(F.xxhash64("pack"), F.lit(ROUNDS)) == r).select(*narrow.columns)
        changes = part.mapInPandas(lambda b, w=now: _descend(b, head, rank, class_of, w), _CHANGE)
        merged = {m["block"]: m for m in changes.groupBy("block").applyInPandas(_merge, _CHANGE).collect()}
        tokens = merged.pop(-1)["tokens"] if -1 in merged else 0
        weights = now.copy()
        for block, m in merged.items():
            change = np.frombuffer(m["change"], "<f8").reshape(-1, CLASSES) / tokens
            weights[block * SLOT_BLOCK : block * SLOT_BLOCK + len(change)] += change.astype(np.float32)
    n, v = totals[0].sum(), totals[1].sum()
    return Model(
        head, rank, class_of, weights, np.log10(class_total), np.log10(unknown), int(n), float(np.log10(n + 0.5 * (v + 1)))
    )


# Scoring.


def counts_by_pack(packs: DataFrame, counts: DataFrame) -> DataFrame:
    """(pack, place, n): for each pack, the local words that training holds and how often."""

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pack, vocab in zip(batch["pack"], batch["vocab"], strict=True):
                hashes = np.frombuffer(vocab, "<i8")
                yield pd.DataFrame({"pack": pack, "place": np.arange(len(hashes), dtype=np.int32), "hash": hashes})

    rows = packs.select("pack", "vocab").mapInPandas(unfold, "pack long, place int, hash long")
    return rows.join(counts.select("hash", "n"), "hash").select("pack", "place", "n")


_SCORES = "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(packs: pd.DataFrame, known: pd.DataFrame, model: Model) -> pd.DataFrame:
    """Scores of the one pack in ``packs``; ``known`` holds its words that training has."""
    row = next(packs.itertuples())
    pack = Pack.of(row)
    seen = np.zeros(len(pack.vocab), dtype=np.float64)
    seen[known["place"].to_numpy()] = known["n"].to_numpy()
    bucket = pack.buckets(model.head, model.rank)
    word_class = model.class_of[bucket]
    log_seen = np.log10(seen + 0.5)
    inner = np.where(seen > 0, log_seen, model.class_log_unknown[word_class]) - model.class_log_total[word_class]
    buckets, starts = bucket[pack.stream], pack.starts()
    score = inner[pack.stream]
    for at in range(0, len(buckets), BATCH * 4):
        part, skip = _part(buckets, at, BATCH * 4)
        slots = context_slots(part, _within(starts, at - skip, len(part)))[skip:]
        chosen = model.class_of[part[skip:]]
        logs = log_softmax(class_logits(model.weights, slots))
        score[at : at + len(chosen)] += logs[np.arange(len(chosen)), chosen] / np.log(10)
    return pd.DataFrame(
        {
            "id": row.ids,
            "held_out": pack.held,
            "n_tokens": pack.lengths,
            "n_known": np.add.reduceat((seen > 0)[pack.stream], starts, dtype=np.int64),
            "base_score": np.add.reduceat((log_seen - model.base_log_total)[pack.stream], starts),
            "score": np.add.reduceat(score, starts),
        }
    )


def score_documents(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    The model learns from all rows that ``held_out`` does not mark and scores every whole text.
    ``id`` is the id as text. A null text counts as empty and is its end token alone. Words are known
    by a 64-bit hash. Repeated rows count and score like any other. Without training rows every
    word is unknown and the base score is 0. Empty tables give no rows. Scores are log10
    probabilities of the tokens with their end; unknown words of a class share one outcome,
    whose weight is the number of the class's words seen once.
    """
    small_batches(df.sparkSession)
    packs = pack_documents(df, id_col, text_col, held_out)
    counts = cut_lineage(word_counts(packs))
    model = train(packs, counts)
    found = packs.select("pack", "ids", "held", "lengths", "low", "high", "vocab", "tails")
    # Groups reach a task's worker one by one; batches of joined packs would be held together.
    both = found.groupBy("pack").cogroup(counts_by_pack(packs, counts).groupBy("pack"))
    scored = both.applyInPandas(lambda own, known: _score(own, known, model), _SCORES)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
