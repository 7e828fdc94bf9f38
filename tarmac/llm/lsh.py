"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected on random Gaussian directions; the projections, shifted and cut
into cells of fixed width, name a bucket in each of several tables. Vectors that share a bucket
are compared by exact cosine. For unit vectors a cosine of 0.93 is a distance of 0.374, at which
one projection agrees with probability 0.80, a table of 6 with 0.26, and one of 16 tables with
0.993; nearer pairs are missed far less often.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import named
from tarmac.llm.components import connected_components, find_roots, union
from tarmac.session import cut_lineage

THRESHOLD = 0.93
TABLES, PROJECTIONS, WIDTH = 16, 6, 1.5
SEED = 42
#: Vectors of a bucket that are compared at once; larger buckets meet in pairs of such blocks.
BLOCK = 1024
#: Bucket entries that a task holds, about.
ENTRIES = 16_384


@functools.cache
def _directions(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    n = TABLES * PROJECTIONS
    odd = rng.integers(1, 1 << 62, size=PROJECTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.standard_normal((dim, n)), rng.uniform(0, WIDTH, n), odd


def bucket_numbers(vectors: np.ndarray) -> np.ndarray:
    """A 32-bit bucket number per row and table, for unit vectors."""
    directions, shift, odd = _directions(vectors.shape[1])
    cells = np.floor((vectors @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(vectors), TABLES, PROJECTIONS)
    mixed = (cells * odd).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _buckets_column(vector: Column) -> Column:
    @F.pandas_udf("array<int>")
    def buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.empty(len(batch), dtype=object)
            lengths = batch.map(len).to_numpy()
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                numbers = bucket_numbers(unit_rows(np.stack(batch.iloc[at].to_list()).astype(np.float64)))
                for row, i in zip(numbers, at, strict=True):
                    out[i] = row
            yield pd.Series(out)

    return buckets(vector)


def _compare(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links among the vectors of each bucket, or between two blocks of one.

    A pair counts in the first table in which it meets, so its count is one whatever the number
    of tables. Returned per vector: links to add and the root of its set of linked vectors.
    """
    rows = rows.sort_values(["label", "dim", "place", "bucket", "a", "b"], kind="stable")
    group = rows.groupby(["label", "dim", "place", "bucket", "a", "b"], sort=False).ngroup().to_numpy()
    limits = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    rep, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
    place, a, b, block = (rows[c].to_numpy() for c in ("place", "a", "b", "block"))
    vectors, buckets = rows["vector"].to_list(), np.stack(rows["buckets"].to_list()) if len(rows) else None
    found = []
    for low, high in zip(limits, limits[1:], strict=False):
        if high - low < 2:
            continue
        part = np.arange(low, high)
        unit = unit_rows(np.stack([vectors[i] for i in part]).astype(np.float64))
        within = a[low] == b[low]
        x = np.flatnonzero(block[part] == a[low])
        y = x if within else np.flatnonzero(block[part] == b[low])
        if not len(x) or not len(y):
            continue
        links = np.zeros(len(part), dtype=np.int64)
        parent = np.arange(len(part))
        for start in range(0, len(x), 128):
            i, j = np.nonzero(unit[x[start : start + 128]] @ unit[y].T >= threshold)
            i, j = x[start + i], y[j]
            keep = i < j if within else rep[part[i]] != rep[part[j]]
            i, j = i[keep], j[keep]
            union(parent, i, j)
            before = place[low]
            met = (buckets[part[i], :before] == buckets[part[j], :before]).any(axis=1)
            i, j = i[~met], j[~met]
            np.add.at(links, i, copies[part[j]])
            np.add.at(links, j, copies[part[i]])
        roots = find_roots(parent, np.arange(len(part)))
        some = np.flatnonzero((links > 0) | (roots != np.arange(len(part))))
        if len(some):
            found.append(pd.DataFrame({"rep": rep[part[some]], "links": links[some], "root": rep[part[roots[some]]]}))
    return pd.concat(found) if found else pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")


def task_groups(sizes: DataFrame) -> int:
    """Groups of about ``ENTRIES`` rows for buckets of ``n`` vectors in ``blocks``: a vector goes once to every block of its bucket."""
    rows = sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    return max(8, -(-rows // ENTRIES))


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, n_links, component) for every row: vectors of equal label link at a cosine of ``threshold``.

    ``n_links`` counts the other rows linked directly, ``component`` is the smallest id reachable.
    Equal vectors of a label are compared once and count as linked copies. Rows link with nothing
    when their id, label or vector is null, the vector is empty or zero, or one of its components
    is null or not finite; vectors of different length do not link. Rows that share an id are one
    item in components. Empty tables give no rows; other columns are not read. A pair that no table
    brings together is missed (see the module's text); no pair below the threshold is linked.
    """
    vector = named(vector_col).cast("array<double>")
    large = F.array_max(F.transform(vector, F.abs))  # null if all are null; NaN is the largest
    valid = named(id_col).isNotNull() & named(label_col).isNotNull() & (F.size(vector) > 0)
    valid &= ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)) & (large > 0) & (large < float("inf"))
    rows = cut_lineage(
        df.select(
            named(id_col).cast("long").alias("id"),
            F.coalesce(valid, F.lit(False)).alias("valid"),
            named(label_col).cast("string").alias("label"),
            vector.alias("vector"),
            F.xxhash64(vector).alias("h1"),
            F.xxhash64(F.lit(SEED), vector, F.size(vector)).alias("h2"),
        )
    )
    reps = rows.where("valid").groupBy("label", "h1", "h2")
    reps = reps.agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    reps = cut_lineage(reps.withColumn("buckets", _buckets_column(F.col("vector"))).withColumn("dim", F.size("vector")))
    bucket = ["label", "dim", "place", "bucket"]
    entries = reps.select("rep", "label", "dim", F.posexplode("buckets").alias("place", "bucket"))
    sizes = entries.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    sizes = cut_lineage(sizes.select(*bucket, "n", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks")))
    groups = task_groups(sizes)
    sizes = sizes.drop("n")
    full = reps.select("rep", "copies", "label", "dim", "vector", "buckets", F.posexplode("buckets").alias("place", "bucket"))
    own = F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int")
    met = full.join(sizes, bucket).withColumn("block", own)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    met = met.withColumn("task", F.pmod(F.xxhash64(*bucket, "a", "b"), F.lit(groups)).cast("int"))
    met = met.select("rep", "copies", "vector", "buckets", *bucket, "block", "a", "b", "task").repartition(groups, "task")
    found = met.groupBy("task").applyInPandas(lambda part: _compare(part, threshold), "rep long, links long, root long")
    found = cut_lineage(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    members = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    known = reps.select("label", "h1", "h2", "rep", "copies").join(links, "rep", "left")
    known = known.join(members.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label",
        "h1",
        "h2",
        F.lit(True).alias("valid"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    joined = rows.select("id", "valid", "label", "h1", "h2").join(known, ["label", "h1", "h2", "valid"], "left")
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component")
    )
