"""Joins that keep working when one key holds a large share of the rows.

A hot key is found with a bounded sketch in one pass, then only that key is salted: the side
with many rows spreads over several join partitions and the other side is copied once per
salt. Cold keys pay nothing, and results are whole either way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.schema import col

TRACKED_KEYS = 10_000
MAX_HOT_KEYS = 1_000
SMALL_BYTES = 256 * 1024 * 1024
ROWS_PER_SALT = 4_000_000
MAX_BROADCAST_ROWS = 100_000
NULL_SALTS = 4_096
_SALT = "_salt"


def size_upper_bound(df: DataFrame) -> int:
    """The optimizer's size estimate, which follows from the input file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hot_keys(
    df: DataFrame, keys: Sequence[str], rows_per_salt: int = ROWS_PER_SALT, small_bytes: int = SMALL_BYTES
) -> dict[int, int]:
    """Key hash → number of salts, for keys with more than ``rows_per_salt`` rows.

    Inputs that are small as a whole cannot hold a hot key and skip the pass.
    """
    if size_upper_bound(df) <= small_bytes:
        return {}
    hashed = df.where(_all_set(keys)).select(key_hash(keys).alias("h"))
    found = hashed.agg(F.expr(f"approx_top_k(h, {MAX_HOT_KEYS}, {TRACKED_KEYS})").alias("top")).first()["top"]
    return {
        item["item"]: -(-item["count"] // rows_per_salt) for item in found if item["count"] > rows_per_salt
    }


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[col(k) for k in keys])


def _all_set(keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & col(k).isNotNull()
    return test


def _salts(keys: Sequence[str], hot: dict[int, int]) -> Column:
    pairs = [F.lit(x).cast("long") for item in hot.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key_hash(keys)), F.lit(1).cast("long"))


def _spread(df: DataFrame, keys: Sequence[str], hot: dict[int, int]) -> DataFrame:
    # The salt follows from the input partition: a retried task repeats it, rows that are
    # copies of each other part, and no column is read for it. Rows without a key match
    # nothing; they take any salt, so that they do not meet in one partition.
    mixed = F.xxhash64(F.spark_partition_id())
    salts = _salts(keys, hot) if hot else F.lit(1).cast("long")
    return df.withColumn(_SALT, F.when(_all_set(keys), F.pmod(mixed, salts)).otherwise(F.pmod(mixed, F.lit(NULL_SALTS))))


def _copied(df: DataFrame, keys: Sequence[str], hot: dict[int, int]) -> DataFrame:
    if not hot:
        # Always 0, but not a literal: a literal would be taken out of the join key.
        return df.withColumn(_SALT, F.pmod(key_hash(keys), F.lit(1)))
    return df.withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("long"), _salts(keys, hot) - 1)))


def join_lookup(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    rows_per_salt: int = ROWS_PER_SALT,
    small_bytes: int = SMALL_BYTES,
    detect: bool = True,
    null_keys: bool = False,
    keys_of: DataFrame | None = None,
) -> DataFrame:
    """Join a table to another with one row per key.

    ``detect`` looks for hot keys in a pass over the keys of ``many``; without it, hot keys
    are left to the adaptive skew join, which can split ``many`` as the preserved side. Use
    it off where computing the keys costs as much as the join. ``null_keys`` spreads rows
    without a key. ``keys_of`` is a narrower table with the keys of all rows of ``many``, to look
    for hot keys in. With neither in play the join is plain and keeps an existing partitioning.
    """
    keys = list(keys)
    if size_upper_bound(many) <= small_bytes:
        return many.join(one, keys, how)
    looked_in, limit = (many, small_bytes) if keys_of is None else (keys_of, -1)  # how narrow it is says nothing of its rows
    hot = hot_keys(looked_in, keys, rows_per_salt, limit) if detect else {}
    if not hot and not null_keys:
        return many.join(one, keys, how)
    return _spread(many, keys, hot).join(_copied(one, keys, hot), [*keys, _SALT], how).drop(_SALT)


def join_details(
    one: DataFrame,
    many: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    rows_per_salt: int = ROWS_PER_SALT,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """Join a table to its 0..n detail rows, keeping rows without details when ``how`` is left.

    The hot side is the one that is *not* preserved, so salting it under a left join would
    invent unmatched copies. A hot key has details by definition: its rows take an inner
    join, and the rest the join that was asked for.
    """
    keys = list(keys)
    hot = hot_keys(many, keys, rows_per_salt, small_bytes)
    if not hot:
        return one.join(many, keys, how)
    is_hot = F.coalesce(key_hash(keys).isin(list(hot)), F.lit(False))
    cold = one.where(~is_hot).join(many.where(~is_hot), keys, how)
    salted = (
        _copied(one.where(is_hot), keys, hot)
        .join(_spread(many.where(is_hot), keys, hot), [*keys, _SALT], "inner")
        .drop(_SALT)
    )
    return cold.unionByName(salted)


def attach_group_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    rows_per_salt: int = ROWS_PER_SALT,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """Group aggregates joined back to the rows.

    Takes the place of a window over the whole partition: the aggregate combines before the
    shuffle and no task sorts or buffers a whole group.
    """
    stats = df.where(_all_set(keys)).groupBy(*[col(k) for k in keys]).agg(*aggregates)
    return join_lookup(df, stats, keys, "left", rows_per_salt, small_bytes)


def held(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """(table, True) with the rows held as a literal table when there are at most ``limit``.

    One run settles the size and keeps the result, so a small aggregate over a large table
    can be broadcast without being computed twice or guessed at.
    """
    rows = df.limit(limit + 1).collect()  # bounded by the limit
    if len(rows) > limit:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def join_small_or_large(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "left", limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``one`` once its size is known to be small; otherwise join on shuffled keys."""
    one, is_small = held(one, limit)
    if is_small:
        return many.join(F.broadcast(one), list(keys), how)
    return join_lookup(many, one, keys, how, detect=False, null_keys=how != "inner")


def row_fingerprint(columns: Sequence[str]) -> list[Column]:
    """128 bits that stand for a whole row, so wide rows need not be shuffled to be compared."""
    picked = [col(c) for c in columns]
    # Nulls do not enter a hash: their places are hashed too.
    places = F.xxhash64(*[c.isNull() for c in picked])
    return [F.xxhash64(*picked, places).alias("_h1"), F.xxhash64(places, F.lit(7), *reversed(picked)).alias("_h2")]
