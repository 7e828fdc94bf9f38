"""Exact quantiles, average ranks and running counts without a global sort.

Everything starts from counts per distinct value, which combine before the shuffle, so a
value that holds a third of the rows is one row here. Running counts then add two parts: an
offset per value range (a table of ranges × columns, small by construction) and a window
inside each range. The range limits come from approximate quantiles; they only balance the
work and do not touch the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import scalar as fx
from tarmac.schema import col

# Every task may send this many values per column to the one that merges them.
EXACT_STATE_LIMIT = 10_000


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(…keep, column, value DOUBLE), nulls left out."""
    picked = df.select(*[col(k) for k in keep], *[col(c).try_cast("double").alias(c) for c in columns])
    return picked.unpivot(list(keep), list(columns), "column", "value").where(F.col("value").isNotNull())


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): rows per distinct value of each numeric column, one scan."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def running_counts(counts: DataFrame, buckets: int = 1024, accuracy: int = 10_000) -> DataFrame:
    """Add ``below`` (rows with a smaller value) and ``total`` to a (column, value, n) table."""
    cuts = counts.groupBy("column").agg(
        F.percentile_approx("value", [i / buckets for i in range(1, buckets)], accuracy).alias("cuts")
    )
    rows = cuts.collect()  # columns × buckets numbers
    if not rows:
        return counts.withColumn("below", F.lit(0).cast("long")).withColumn("total", F.lit(0).cast("long"))
    limits = F.create_map(
        *[x for r in rows for x in (F.lit(r["column"]), F.array(*[F.lit(float(v)) for v in sorted(set(r["cuts"]))]))]
    )
    # Known not to be null: a null test of the join below would be pushed through the counts and search the limits once per row.
    placed = counts.withColumn(
        "bucket", F.coalesce(fx.count_below(F.element_at(limits, F.col("column")), F.col("value")), F.lit(0))
    )
    per_bucket = placed.groupBy("column", "bucket").agg(F.sum("n").alias("bucket_n"))
    # At most `buckets` rows per column.
    by_column = Window.partitionBy("column")
    offsets = per_bucket.select(
        "column",
        "bucket",
        (F.sum("bucket_n").over(by_column.orderBy("bucket")) - F.col("bucket_n")).alias("before"),
        F.sum("bucket_n").over(by_column).alias("total"),
    )
    inside = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("inside", F.sum("n").over(inside) - F.col("n"))
        .join(F.broadcast(offsets), ["column", "bucket"])
        .select("column", "value", "n", (F.col("before") + F.col("inside")).alias("below"), "total")
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    state_limit: int = EXACT_STATE_LIMIT,
    approx: bool = False,
    accuracy: int = 10_000,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several numeric columns, ``{column: [q, …]}``.

    ``percentile`` holds every distinct value of a column in one task. It is used only after
    a one-pass estimate says that this state is small; otherwise the quantiles are read off
    the running counts, which never gather a column in one place. ``approx`` skips both.
    """
    columns = list(columns)
    probabilities = [float(p) for p in probabilities]
    if not columns:
        return {}
    cast = {c: col(c).try_cast("double") for c in columns}
    if approx:
        row = df.agg(
            *[F.percentile_approx(cast[c], probabilities, accuracy).alias(f"q{i}") for i, c in enumerate(columns)]
        ).first()
        return {c: list(row[f"q{i}"] or [None] * len(probabilities)) for i, c in enumerate(columns)}
    sizes = df.agg(
        *[F.approx_count_distinct(cast[c], 0.05).alias(f"d{i}") for i, c in enumerate(columns)]
    ).first()
    small = [c for i, c in enumerate(columns) if sizes[f"d{i}"] <= state_limit]
    large = [c for c in columns if c not in small]
    result: dict[str, list[float | None]] = {}
    if small:
        row = df.agg(
            *[F.percentile(cast[c], F.array(*[F.lit(p) for p in probabilities])).alias(f"q{i}") for i, c in enumerate(small)]
        ).first()
        for i, c in enumerate(small):
            result[c] = list(row[f"q{i}"] or [None] * len(probabilities))
    if large:
        result.update(_quantiles_from_counts(df, large, probabilities))
    return result


def _quantiles_from_counts(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float | None]]:
    ordered = running_counts(distinct_counts(df, columns))
    wanted = F.array(*[F.lit(p) for p in probabilities])
    spots = ordered.withColumn("p", F.explode(wanted)).withColumn("at", F.col("p") * (F.col("total") - 1))
    low = F.floor("at").between(F.col("below"), F.col("below") + F.col("n") - 1)
    high = F.ceil("at").between(F.col("below"), F.col("below") + F.col("n") - 1)
    hits = spots.where(low | high).groupBy("column", "p").agg(
        F.max("at").alias("at"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    found = {(r["column"], r["p"]): r for r in hits.collect()}  # columns × probabilities rows
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for p in probabilities:
            r = found.get((c, p))
            if r is None:
                out[c].append(None)
                continue
            share = r["at"] - math.floor(r["at"])
            out[c].append(r["lo"] + (r["hi"] - r["lo"]) * share)
    return out


def medians(df: DataFrame, columns: Sequence[str], **options) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5], **options).items()}


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, rank): the mean of the 1-based positions that equal values share."""
    ordered = running_counts(distinct_counts(df, columns))
    return ordered.select("column", "value", "n", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): most frequent non-null value as text, the smallest one on ties."""
    texts = df.select(*[col(c).cast("string").alias(c) for c in columns])
    counts = (
        texts.unpivot([], list(columns), "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("order"), "value", "n")).alias("b"))
    return best.select("column", F.col("b.value").alias("value"), F.col("b.n").alias("n"))


def interpolated(values: Column, p: float) -> Column:
    """Quantile of a sorted, bounded array column; for small per-row arrays only."""
    n = F.size(values)
    at = F.lit(p) * (n - 1)
    low = F.element_at(values, (F.floor(at) + 1).cast("int"))
    high = F.element_at(values, (F.ceil(at) + 1).cast("int"))
    return low + (high - low) * (at - F.floor(at))
