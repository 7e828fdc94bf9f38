"""Each row with the next one in an order, without a sort in one task.

Ranges of the key, from approximate quantiles, are sorted apart. The first row of each range is copied to
the end of the range before it, so every row's next one is in its own task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about, and ranges at most; rows stream through a task, so a range may be large.
RANGE_ROWS, MAX_RANGES = 1000, 10_000


def with_next(
    rows: DataFrame, handle: Callable[[list[tuple[int, str]]], list], schema: str, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Run ``handle`` on runs of (id, text) rows by descending id; it returns a result per row but the last.

    The row after the last one is the first. Ties follow the text, descending; null ids come last.
    """
    count = rows.count()
    ranges = int(min(MAX_RANGES, max(1, count // range_rows)))
    cuts: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(rows.select(F.percentile_approx("id", shares, 20 * ranges)).first()[0] or []))
    limits = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = np.full(len(ids), len(limits) + 1)
        values = ids[known].astype("int64").to_numpy()
        at[known] = len(limits) - np.searchsorted(limits, values, side="left")
        return pd.Series(at)

    marked = rows.select("id", "text", range_of("id").alias("part"))
    order = F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "text")
    heads = marked.groupBy("part").agg(F.max(order).alias("head"))  # a row per range
    ring = Window.orderBy("part")
    before = F.coalesce(F.lag("part").over(ring), F.max("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = heads.withColumn("before", before).select(
        F.when(F.col("head.known"), F.col("head.id")).alias("id"), F.col("head.text").alias("text"), F.col("before").alias("part"), F.lit(True).alias("guest")
    )
    dealt = marked.withColumn("guest", F.lit(False)).unionByName(guests).repartition(max(8, ranges), "part")
    dealt = dealt.sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), F.col("text").desc())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, str]] = []
        part = None
        for batch in batches:
            ids = batch["id"].astype(object).where(batch["id"].notna(), None)
            out = []
            for row_part, guest, row_id, text in zip(batch["part"], batch["guest"], ids, batch["text"], strict=True):
                if row_part != part:
                    held, part = [], row_part
                held.append((None if row_id is None else int(row_id), text))
                if guest or len(held) > 64:
                    out += handle(held)
                    held = held[-1:]
            yield pd.DataFrame(out, columns=columns)

    columns = [field.split()[0] for field in schema.split(", ")]
    return dealt.mapInPandas(run, schema)
