"""Profiles: null counts, descriptive statistics, histograms, frequencies, fences, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.order_stats import distinct_counts, exact_quantiles, long_values
from tarmac.operators.skew import join_lookup, row_fingerprint
from tarmac.schema import col
from tarmac.session import cut_lineage


def null_profile(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """(column, nulls, rows, pct) for every column from one scan."""
    rows = F.count(F.lit(1))
    one = df.agg(rows.alias("_rows"), *[F.count_if(col(c).isNull()).alias(c) for c in df.columns])
    out = one.unpivot(["_rows"], df.columns, "column", "nulls").select(
        "column",
        "nulls",
        F.col("_rows").alias("rows"),
        F.round(F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("_rows")), F.lit(0.0)), 2).alias("pct"),
    )
    return out.where(F.col("nulls") > 0) if only_missing else out


def top_missing(df: DataFrame, n: int = 12) -> DataFrame:
    return null_profile(df).orderBy(F.desc("nulls"), "column").limit(n)


def over_missing(df: DataFrame, more_than: float = 50.0) -> DataFrame:
    return null_profile(df).where(F.col("pct") > more_than)


def descriptive_stats(df: DataFrame, columns: Sequence[str], min_rows: int = 10, **options) -> DataFrame:
    """One row per column with at least ``min_rows`` values.

    Sample standard deviation, population skewness and excess kurtosis. Moments and extremes
    combine before the shuffle, distinct values come from the counts per value, medians from
    the exact quantiles.
    """
    middle = exact_quantiles(df, columns, [0.5], **options)
    medians = [(c, q[0]) for c, q in middle.items() if q[0] is not None]
    values = long_values(df, columns)
    stats = values.groupBy("column").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
        F.count(F.lit(1)).alias("n_valid"),
    )
    distinct = distinct_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("cardinality"))
    median = df.sparkSession.createDataFrame(medians, "column string, median double")
    return (
        stats.where(F.col("n_valid") >= min_rows)
        .join(F.broadcast(median), "column")
        .join(distinct, "column")
        .select("column", "min", "max", "mean", "median", "std", "skewness", "kurtosis", "n_valid", "cardinality")
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins from min to max per column, last bin closed, empty bins included."""
    values = long_values(df, columns)
    edges = values.groupBy("column").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n_valid")
    )
    # A constant column gets one unit of width around its value, as NumPy does.
    edges = edges.select(
        "column",
        "n_valid",
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    limits = F.broadcast(edges)  # one row per named column
    place = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counted = (
        distinct_counts(df, columns)
        .join(limits, "column")
        .withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
        .groupBy("column", "bin")
        .agg(F.sum("n").alias("n"))
    )
    spine = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return spine.join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("lo") + width * F.col("bin")).alias("bin_start"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) * 100.0 / F.col("n_valid")).alias("pct"),
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) over non-null values, one scan for all columns."""
    texts = df.select(*[col(c).cast("string").alias(c) for c in columns])
    return (
        texts.unpivot([], list(columns), "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, pct) per class. The share window runs over one row per class."""
    counts = df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def imbalance(df: DataFrame, label: str, min_percent: float = 5.0) -> DataFrame:
    """One row: majority / minority ratio, rarest share, and whether it reaches the minimum."""
    counts = df.where(col(label).isNotNull()).groupBy(col(label)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("classes"),
        (F.max("n") / F.min("n")).alias("ratio"),
        (F.min("n") * 100.0 / F.sum("n")).alias("minority_pct"),
    ).withColumn("is_balanced", (F.col("minority_pct") >= min_percent).cast("int"))


def is_label_frequent(df: DataFrame, label: str, value: str, min_percent: float = 5.0) -> bool:
    """Whether one class (by default the rare one) holds at least ``min_percent`` of the rows."""
    row = df.agg(F.count_if(col(label) == value).alias("k"), F.count(F.lit(1)).alias("n")).first()
    return bool(row["n"]) and 100.0 * row["k"] / row["n"] >= min_percent


def fences(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5, **options) -> dict[str, tuple]:
    """Column → (q1, q3, lower fence, upper fence); columns without values are left out."""
    out = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75], **options).items():
        if q1 is not None:
            out[c] = (q1, q3, q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
    return out


def iqr_outliers(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5, bounds: dict[str, tuple] | None = None, **options) -> DataFrame:
    """(column, q1, q3, lower_fence, upper_fence, outliers, n_valid) per column, one pass for all counts.

    ``bounds`` are fences that the caller has already.
    """
    bounds = fences(df, columns, multiplier, **options) if bounds is None else bounds
    if not bounds:
        return df.sparkSession.createDataFrame(
            [], "column string, q1 double, q3 double, lower_fence double, upper_fence double, outliers long, n_valid long"
        )
    limits = df.sparkSession.createDataFrame(
        [(c, *map(float, b)) for c, b in bounds.items()],
        "column string, q1 double, q3 double, lower_fence double, upper_fence double",
    )
    aggs = []
    for c, (_, _, low, high) in bounds.items():
        value = col(c).try_cast("double")
        aggs += [
            F.count_if((value < low) | (value > high)).alias(f"{c}#out"),
            F.count(value).alias(f"{c}#n"),
        ]
    one = df.agg(*aggs)
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), col(f"{c}#out").alias("outliers"), col(f"{c}#n").alias("n_valid")) for c in bounds]
    )
    counts = one.select(F.explode(entries).alias("e")).select("e.*")
    return F.broadcast(limits).join(counts, "column")


def top_outliers(df: DataFrame, columns: Sequence[str], n: int = 7, **options) -> DataFrame:
    """Columns with the largest share of outliers."""
    return (
        iqr_outliers(df, columns, **options)
        .where(F.col("outliers") > 0)
        .withColumn("pct_outliers", F.round(F.col("outliers") * 100.0 / F.col("n_valid"), 2))
        .orderBy(F.desc("outliers"), "column")
        .limit(n)
    )


def date_span(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(col(day)).alias("earliest"), F.max(col(day)).alias("latest"))


def rows_per_key(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys and mean rows per key (rows without a key do not count)."""
    keys = df.where(col(key).isNotNull()).groupBy(col(key)).agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.count(F.lit(1)).alias("keys"), F.avg("n").alias("rows_per_key"))


def duplicate_counts(df: DataFrame, composite: Sequence[str], key: str) -> DataFrame:
    """One row: surplus rows by full row, by composite key and by single key.

    Each level aggregates the one before it, so the table is scanned once and copies
    collapse before the first shuffle.
    """
    keys = [col(c) for c in composite]
    # Rows of one composite key that differ get different fingerprints.
    full = df.select(*keys, *row_fingerprint(df.columns)).groupBy(*keys, "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    by_composite = full.groupBy(*[col(c) for c in composite]).agg(
        F.sum("_n").alias("_n"), F.sum(F.col("_n") - 1).alias("_full")
    )
    by_key = by_composite.groupBy(col(key)).agg(
        F.sum("_n").alias("_n"), F.sum("_full").alias("_full"), F.sum(F.col("_n") - 1).alias("_composite")
    )
    return by_key.agg(
        F.coalesce(F.sum("_full"), F.lit(0)).alias("full_duplicates"),
        F.coalesce(F.sum("_composite"), F.lit(0)).alias("composite_duplicates"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("key_repeats"),
    )


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None, **skew_options) -> DataFrame:
    """Every member of a group of equal rows (or equal ``subset``), the first one included."""
    by = list(subset or df.columns)
    marked = df.select("*", *row_fingerprint(by))
    # Hot keys and counts read fingerprints alone: these are computed once for both, and written without the rows.
    prints = cut_lineage(marked.select("_h1", "_h2"))
    repeated = prints.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    return join_lookup(marked, repeated, ["_h1", "_h2"], "inner", keys_of=prints, **skew_options).drop("_h1", "_h2")
