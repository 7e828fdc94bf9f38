"""Connected components over link tables, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.session import cut_lineage


def find_roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    roots = parent[nodes]
    while True:
        up = parent[roots]
        if np.array_equal(up, roots):
            return roots
        roots = up


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of each pair (a[i], b[i]) in place; the smaller root stays."""
    while len(a):
        a, b = find_roots(parent, a), find_roots(parent, b)
        differ = a != b
        a, b = a[differ], b[differ]
        if len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def star_edges(parent: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """(src, dst) rows from every node that has another root to that root: a spanning forest."""
    roots = find_roots(parent, np.arange(len(parent)))
    linked = np.flatnonzero(roots != np.arange(len(parent)))
    return pd.DataFrame({"src": ids[linked], "dst": ids[roots[linked]]})


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's links as a spanning forest of stars; holds one link per node at most."""
    kept = np.empty((0, 2), dtype=np.int64)
    for batch in batches:
        pairs = np.concatenate([kept, batch[["src", "dst"]].to_numpy(dtype=np.int64)])
        ids, inverse = np.unique(pairs, return_inverse=True)
        inverse = inverse.reshape(-1, 2)
        parent = np.arange(len(ids))
        union(parent, inverse[:, 0], inverse[:, 1])
        kept = star_edges(parent, ids).to_numpy()
    yield pd.DataFrame(kept, columns=["src", "dst"])


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node has one link at most and no link leads to a node that has one."""
    roles = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")))).alias("r"))
    roles = roles.groupBy("r.node").agg(F.sum("r.out").alias("out"), F.min("r.out").alias("least"))
    return roles.where("out > 1 or (out = 1 and least = 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m"))
    least = least.select("src", F.least("src", "m").alias("m"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
    return moved.union(least.select("src", F.col("m").alias("dst"))).distinct()


def contract_files(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Contract partition by partition while Spark packs the files written into fewer partitions.

    True once one partition has held all links. Partitions never exceed Spark's file packing size.
    """
    current = cut_lineage(edges)
    while True:
        width = current.rdd.getNumPartitions()
        current = cut_lineage(current.mapInPandas(_contract, "src long, dst long"))
        if width <= 1:
            return current, True
        if current.rdd.getNumPartitions() >= width:
            return current, False


def star_rounds(edges: DataFrame) -> DataFrame:
    """Large and small stars in turn until every node points at its root."""
    while not _is_forest(edges):
        edges = cut_lineage(_small_star(_large_star(edges)))
    return edges


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (src, dst): component is the smallest node reachable.

    Nodes are longs; self-links and repeated links do no harm. Links are first contracted where
    they lie, without a shuffle; what is then left in several partitions takes rounds whose number grows
    with the logarithm of the number of nodes. A hub costs no more than its links, since rounds
    only take minima and joins that Spark can split. Every step works on a written table.
    """
    linked = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    current, done = contract_files(linked)
    if not done:
        current = star_rounds(current)
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
