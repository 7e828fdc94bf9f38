"""Quality classifier: a generalised additive model with pairwise interactions.

Surface features of a text are binned. Shallow trees, boosted in turn over the features and then
over the pairs that explain most of what is left, add up to one lookup table per feature and one
per pair. A score is the logistic function of the sum of a text's table entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import named, text_or_empty

#: Labelled rows the model is fitted on, about; more are thinned by a hash of their key.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS = 150, 50
RATE, RIDGE, MIN_LEAF = 0.15, 2.0, 10
THRESHOLD = 0.3

FEATURES = (
    "log_chars log_words word_length upper digits sentence_marks exclamations bars symbols line_breaks "
    "beyond_ascii distinct_words repeated_next top_word repeated_lines short_words capitalised bare_words"
).split()
_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "sentence_marks": b".,;:?",
    "exclamations": b"!",
    "bars": b"|",
    "symbols": b"#$%&*@^~<>{}[]\\/_=+`",
    "line_breaks": b"\n",
    "beyond_ascii": bytes(range(128, 256)),
}
_IN_GROUP = np.zeros((256, len(_GROUPS)))
for _i, _members in enumerate(_GROUPS.values()):
    _IN_GROUP[list(_members), _i] = 1.0


def features(text: str) -> list[float]:
    """Surface features of a whole text, in the order of ``FEATURES``; all zero for an empty one."""
    raw = text.encode("utf-8")
    words = raw.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(FEATURES) - 1)
    n = len(words)
    shares = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _IN_GROUP / len(raw)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        *shares.tolist(),
        len(counts) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        sum(len(w) <= 3 for w in words) / n,
        sum(w[:1].isupper() for w in words) / n,
        sum(map(bytes.isalpha, words)) / n,
    ]


@dataclass
class Model:
    """Lookup tables over bins; ``edges`` are the upper limits of all bins but the last."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float = 0.0
    mains: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.mains):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (j, k), table in self.pairs.items():
            total += table[coarse[j], coarse[k]]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Best gain and place of one cut through ordered bins."""
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h, all_n = g.sum(), h.sum(), n.sum()
    gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain[(left_n < MIN_LEAF) | (all_n - left_n < MIN_LEAF)] = 0.0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of three leaves over ordered bins, as a value per bin."""
    limits = [0, len(g)]
    for _ in range(2):
        found = [(*_cut(g[a:b], h[a:b], n[a:b]), a) for a, b in zip(limits, limits[1:], strict=False)]
        gain, at, start = max(found)
        if gain <= 0:
            break
        limits = sorted([*limits, start + at])
    out = np.zeros(len(g))
    for a, b in zip(limits, limits[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Cut one side, then the other within each part; gain and value per cell."""
    best, out = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        _, at = _cut(a.sum(1), b.sum(1), c.sum(1))
        total, cells = 0.0, np.zeros_like(a)
        for rows in (slice(0, at), slice(at, len(a))):
            if rows.start == rows.stop:
                continue
            _, col = _cut(a[rows].sum(0), b[rows].sum(0), c[rows].sum(0))
            for cols in (slice(0, col), slice(col, a.shape[1])):
                top, low = a[rows, cols].sum(), b[rows, cols].sum() + RIDGE
                total += top**2 / low
                cells[rows, cols] = top / low
        total -= g.sum() ** 2 / (h.sum() + RIDGE)
        if total > best:
            best, out = total, cells.T if turned else cells
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on a bounded sample; without both labels the model is their share, 0.5 without any."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model([], [], float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    order = np.lexsort([*x.T, y])  # the same sums in whatever order the rows arrive
    x, y = x[order], y[order].astype(float)
    width = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(width)]
    model.coarse = [_edges(x[:, j], PAIR_BINS) for j in range(width)]
    fine = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(width)]
    model.mains = [np.zeros(len(e) + 1) for e in model.edges]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(fine, model.mains, strict=True)]
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j in range(width):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(fine[j], y - p, len(model.mains[j]))
            h = np.bincount(fine[j], p * (1 - p), len(model.mains[j]))
            step = RATE * _tree(g, h, sizes[j])
            model.mains[j] += step
            total += step[fine[j]]
    coarse = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in range(width)]
    shape = [len(e) + 1 for e in model.coarse]

    def cells(j: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(coarse[j] * shape[k] + coarse[k], weights, shape[j] * shape[k]).reshape(shape[j], shape[k])

    p = 1 / (1 + np.exp(-total))
    gains = [
        (_pair_tree(cells(j, k, y - p), cells(j, k, p * (1 - p)), cells(j, k))[0], j, k)
        for j in range(width)
        for k in range(j + 1, width)
    ]
    chosen = [(j, k) for gain, j, k in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    model.pairs = {(j, k): np.zeros((shape[j], shape[k])) for j, k in chosen}
    for _ in range(PAIR_ROUNDS):
        for (j, k), table in model.pairs.items():
            p = 1 / (1 + np.exp(-total))
            _, step = _pair_tree(cells(j, k, y - p), cells(j, k, p * (1 - p)), cells(j, k))
            table += RATE * step
            total += RATE * step[coarse[j], coarse[k]]
    return model


def features_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t or "") for t in texts], dtype=object)

    return extract(text)


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> Model:
    """Fit on the rows of ``df`` that ``labels`` (id, label 0/1) marks.

    About ``sample`` labels are used at most: a hash of the key decides, so the draw is the same
    on every run. Rows without a key, a label or a match are left out. A repeated key counts
    once: by the majority of its labels (1 on a tie) and the smallest of its texts.
    """
    marked = labels.select(named(id_col).alias("_id"), named(label_col).cast("int").alias("_label"))
    marked = marked.where("_id is not null and _label in (0, 1)").groupBy("_id")
    marked = marked.agg((F.avg("_label") >= 0.5).cast("double").alias("_label"))
    count = marked.count()
    if count > sample:
        marked = marked.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < int(sample / count * (1 << 40)))
    # One row per key, thinned: bounded by the sample size, whatever the tables hold.
    texts = df.select(named(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    found = texts.join(F.broadcast(marked), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    rows = found.select(features_column(F.col("_text")).alias("x"), "_label").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["_label"].to_numpy(dtype=float))


def score_column(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t or "") for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x))

    return score(text)


def score_quality(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add a score between 0 and 1, higher where label 1 is likelier.

    Only the text decides, and all of it: equal texts have equal scores, null counts as empty and
    empty texts are scored by their features like any other. Empty tables stay empty. A column
    named ``score_col`` already is replaced; all others are kept.
    """
    return df.withColumn(score_col, score_column(text_or_empty(text_col), model))
