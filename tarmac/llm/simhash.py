"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are packed into blocks by population count. Two fingerprints that differ in
at most r bits have counts at most r apart, so only blocks of near counts meet. A meeting is
one row with two packed blocks; its task compares tiles by exclusive-or and bit counts, skips
tiles whose half-word counts lie too far apart, and returns a spanning forest of the links it
finds, never the pairs. The comparison is exact; its work is the square of the number of distinct
fingerprints over the share of blocks that are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import named, scratch_name, text_or_empty
from tarmac.llm.components import connected_components, star_edges, union
from tarmac.session import cut_lineage

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a block at most (8 bytes each), whatever the number of rows.
BLOCK = 65_536
#: Parts in which a block travels, so that no task gathers a whole block before blocks meet.
SLICES = 16
_TILE, _COLUMNS = 64, 4096
_SLICE = 1 << 15


def shingle_hashes(text: str, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    words = text.encode("utf-8").lower().split()
    h, k = xxhash.xxh64_intdigest, words_per_shingle
    if len(words) <= k:
        hashes = [h(b" ".join(words), seed)] if words else []
    else:
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - k + 1].tolist()
        hashes = [h(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(text: str, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is set when over half of the shingle hashes have it; 0 without words."""
    hashes = shingle_hashes(text, words_per_shingle, seed)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = [fingerprint(t or "", words_per_shingle, seed) for t in texts]
            yield pd.Series(np.array(prints, dtype=np.uint64).view(np.int64))

    return simhash(text)


def _half_sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    high = np.bitwise_count(values >> np.uint64(32)).astype(np.int64)
    order = np.argsort(high, kind="stable")
    return values[order], high[order]


def compare_blocks(a: np.ndarray, b: np.ndarray | None, radius: int) -> pd.DataFrame:
    """Spanning forest of the links between two blocks, or within one (``b`` is None).

    All values of a block have one population count.
    """
    a, a_high = _half_sorted(a)
    within = b is None
    b, b_high = (a, a_high) if within else _half_sorted(b)
    shift = 0 if within else len(a)
    ids = a if within else np.concatenate([a, b])
    parent = np.arange(len(ids))
    gap = int(np.bitwise_count(b[0])) - int(np.bitwise_count(a[0])) if len(a) and len(b) else 0
    # |d| + |gap - d| <= radius bounds the difference d of the upper half's counts.
    least, most = -((radius - gap) // 2), (radius + gap) // 2
    for i in range(0, len(a), _TILE):
        tile, high = a[i : i + _TILE], a_high[i : i + _TILE]
        start = np.searchsorted(b_high, high[0] + least, "left")
        stop = np.searchsorted(b_high, high[-1] + most, "right")
        for j in range(max(start, i) if within else start, stop, _COLUMNS):
            near = np.bitwise_count(tile[:, None] ^ b[None, j : min(j + _COLUMNS, stop)]) <= radius
            if within or near.any():
                x, y = np.nonzero(near)
                x, y = x + i, y + j
                if within:
                    x, y = x[x < y], y[x < y]
                union(parent, x, y + shift)
    return star_edges(parent, ids.view(np.int64))


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(src, dst) links that connect all distinct values of ``fp`` within ``radius`` bits.

    Every group that is connected by such differences is connected by the rows returned.
    """
    spark = prints.sparkSession
    classed = prints.select("fp").distinct().withColumn("ones", F.bit_count("fp").cast("int"))
    counts = {r["ones"]: r["n"] for r in classed.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 at most
    blocks = [-(-counts.get(c, 0) // block) for c in range(65)]
    first = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    low = [first[max(0, c - radius)] for c in range(65)]
    high = [first[min(64, c + radius) + 1] - 1 for c in range(65)]
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("ones") + 1)
    numbered = classed.withColumn("block", pick(first[:65]) + F.pmod(F.xxhash64("fp"), pick([max(1, n) for n in blocks])).cast("int"))
    sliced = numbered.withColumn("slice", F.pmod(F.xxhash64("fp", F.lit("slice")), F.lit(SLICES)).cast("int"))
    packed = sliced.groupBy("block", "slice").agg(F.collect_list("fp").alias("fps"), F.min("ones").alias("ones"))
    # Each block goes once to every block of near count, itself included.
    met = packed.withColumn("other", F.explode(F.sequence(pick(low), pick(high))))
    met = met.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "fps")
    left, right = F.col("block") == F.col("a"), (F.col("block") == F.col("b")) & (F.col("a") != F.col("b"))
    both = met.repartition(max(8, first[65]), "a", "b").groupBy("a", "b").agg(
        F.flatten(F.collect_list(F.when(left, F.col("fps")))).alias("x"),
        F.flatten(F.collect_list(F.when(right, F.col("fps")))).alias("y"),
    )  # two blocks

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for within, x, y in zip(batch["a"] == batch["b"], batch["x"], batch["y"], strict=True):
                x, y = (np.asarray(v, dtype=np.int64).view(np.uint64) for v in (x, y))
                yield compare_blocks(x, None if within else y, radius)

    if first[65] == 0:
        return spark.createDataFrame([], "src long, dst long")
    return both.mapInPandas(compare, "src long, dst long")


def grouped(prints: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, root, component) of every distinct ``fp`` of ``prints`` (id, fp) under the links ``found`` between them."""
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first"))
    members = connected_components(found).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = cut_lineage(distinct.join(members, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return rooted.join(least, "root").select("fp", "root", "component")


def classes(df: DataFrame, id_col: str, text_col: str, radius: int, words_per_shingle: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, and (fp, root, component) of every distinct fingerprint."""
    fp = fingerprint_column(text_or_empty(text_col), words_per_shingle).alias("fp")
    prints = cut_lineage(df.select(named(id_col).cast("long").alias("id"), fp))
    return prints, grouped(prints, links(prints, radius))


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    words_per_shingle: int = SHINGLE_WORDS,
) -> DataFrame:
    """(id, fp, component) for every row: equal component means linked, directly or by way of others.

    ``fp`` is the fingerprint as a signed long; ``component`` the smallest id reachable, the row's
    own included. Texts are taken whole; null counts as empty. Texts without words have fingerprint
    0 and are linked like any other. Repeated rows share fingerprint and component; rows with a
    null id are linked but never name a component, which is null where no other row is linked.
    Empty tables give no rows; other columns are not read.
    """
    prints, by_print = classes(df, id_col, text_col, radius, words_per_shingle)
    return prints.join(by_print, "fp").select("id", "fp", "component")


def keep_one(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    words_per_shingle: int = SHINGLE_WORDS,
) -> DataFrame:
    """The rows of ``df`` that stay when each group of near-duplicates keeps its smallest id.

    Rows that share an id count as one document, of which one row stays. Rows without an id stay
    only where no row of their group has one, and then one of them. Columns are those of ``df``.
    """
    prints, by_print = classes(df, id_col, text_col, radius, words_per_shingle)
    return keep_first(df, id_col, prints, by_print, fingerprint_column(text_or_empty(text_col), words_per_shingle))


def keep_first(df: DataFrame, id_col: str, prints: DataFrame, by_print: DataFrame, fp_of: Column) -> DataFrame:
    """``keep_one`` from the rows' fingerprints and the groups of these; ``fp_of`` computes a row's fingerprint."""
    fp, root = scratch_name(df, "_fp"), scratch_name(df, "_root")
    kept = prints.join(by_print, "fp").where("id = component").select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col)).distinct()
    with_id = df.where(named(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    nameless = by_print.where("component is null").select(F.col("fp").alias(fp), F.col("root").alias(root))
    without = df.where(named(id_col).isNull()).withColumn(fp, fp_of)
    without = without.join(nameless, fp).dropDuplicates([root]).select(*map(named, df.columns))
    return with_id.select(*map(named, df.columns)).unionByName(without)
