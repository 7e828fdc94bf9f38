"""Cleaning: column drops, row filters, recodes, duplicates, and the audit of what they removed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tarmac import presets
from tarmac.functions import scalar as fx
from tarmac.schema import col, guard, present


def null_shares(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    """Share of nulls per column from one aggregate; an empty table gives 0."""
    columns = list(columns or df.columns)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)],
    ).first()
    rows = row["rows"]
    return {c: (row[f"c{i}"] / rows if rows else 0.0) for i, c in enumerate(columns)}


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*present(df, names))


def drop_sparse_columns(
    df: DataFrame, named: Sequence[str] = presets.SPARSE_COLUMNS, min_share: float = 0.97
) -> DataFrame:
    """Drop the named columns and every column whose null share reaches ``min_share``."""
    rest = drop_columns(df, named)
    shares = null_shares(rest)
    return rest.drop(*[c for c, share in shares.items() if share >= min_share])


def drop_columns_over_missing(
    df: DataFrame, max_percent: float = 50.0, keep: Sequence[str] = presets.WEATHER_KEEP
) -> DataFrame:
    """Drop columns with more than ``max_percent`` nulls, other than the keep list."""
    shares = null_shares(df)
    return df.drop(*[c for c, share in shares.items() if share * 100 > max_percent and c not in keep])


def filter_valid_set(
    df: DataFrame, column: str = "Speed_limit", valid: Sequence = presets.SPEED_LIMITS, on_missing: str = "skip"
) -> DataFrame:
    """Keep rows whose value is in the set; nulls go too."""
    return df.where(col(column).isin(*valid)) if guard(df, [column], on_missing) else df


def require_non_null(df: DataFrame, columns: Sequence[str] = presets.REQUIRED_COLUMNS) -> DataFrame:
    """Drop rows with a null in any of the columns that are present."""
    here = present(df, columns)
    return df.where(_all_known(df, here)) if here else df


def _all_known(df: DataFrame, columns: Sequence[str]) -> Column:
    """No null and no NaN, as single tests that a file reader understands."""
    kinds = dict(df.dtypes)
    tests = [col(c).isNotNull() & ~F.isnan(col(c)) if kinds.get(c) in ("float", "double") else col(c).isNotNull() for c in columns]
    return reduce(lambda a, b: a & b, tests)


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.where(_all_known(df, df.columns)) if df.columns else df


def first_columns(df: DataFrame, n: int) -> DataFrame:
    """Positional projection; prefer names where they are known."""
    return df.select(*[col(c) for c in df.columns[:n]])


def fix_day_of_week(
    df: DataFrame, date: str = "Date", day: str = "Day_of_Week", mode: str = "overwrite", on_missing: str = "skip"
) -> DataFrame:
    """Overwrite the weekday from the date, or (``drop``) remove both columns."""
    if mode not in ("overwrite", "drop"):
        raise ValueError("mode must be 'overwrite' or 'drop'")
    if not guard(df, [date, day], on_missing):
        return df
    if mode == "drop":
        return df.drop(date, day)
    return df.withColumn(day, F.coalesce(fx.day_name(date), col(day)))


def null_if_not_matching(
    df: DataFrame,
    column: str = "Age_Band_of_Driver",
    pattern: str = presets.AGE_BAND_PATTERN,
    on_missing: str = "skip",
) -> DataFrame:
    if not guard(df, [column], on_missing):
        return df
    return df.withColumn(column, F.when(col(column).rlike(pattern), col(column)))


def null_if_sentinel(df: DataFrame, column: str, sentinel: str = presets.SENTINEL, on_missing: str = "skip") -> DataFrame:
    if not guard(df, [column], on_missing):
        return df
    return df.withColumn(column, F.nullif(col(column), F.lit(sentinel)))


def recode_with_fallback(
    df: DataFrame,
    column: str = "Sex_of_Driver",
    allowed: Sequence[str] = presets.SEX_CODES,
    aliases: Mapping[str, str] = presets.SEX_ALIASES,
    fallback: str = "Not known",
    on_missing: str = "skip",
) -> DataFrame:
    """Values outside the list become the fallback, then aliases become full names."""
    if not guard(df, [column], on_missing):
        return df
    kept = F.when(fx.is_member(col(column), allowed), col(column)).otherwise(F.lit(fallback))
    return df.withColumn(column, F.coalesce(fx.lookup(kept, aliases), kept))


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: fx.to_number(c) for c in present(df, columns)})


def exclude_leakage(df: DataFrame, leakage: Sequence[str] = presets.LEAKAGE_COLUMNS) -> DataFrame:
    return drop_columns(df, leakage)


def having_more_than(groups: DataFrame, count_column: str, more_than: int) -> DataFrame:
    return groups.where(col(count_column) > more_than)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Copies collapse before the shuffle, so a large group of copies costs one row per task."""
    return df.dropDuplicates()


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order, ties broken by the remaining columns.

    An aggregate rather than a ranked window: it combines before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    ordered = F.min(F.struct(*[col(c) for c in order_by], *[col(c) for c in rest])).alias("_first")
    return df.groupBy(*[col(k) for k in keys]).agg(ordered).select(
        *[col(c) if c in keys else F.col("_first").getField(c).alias(c) for c in df.columns]
    )


class CleaningAudit:
    """Row counts around each step, observed while the result is computed; no extra job.

    ``steps`` records lazily: read ``table`` after an action on the cleaned DataFrame.
    """

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation]] = []

    def mark(self, df: DataFrame, step: str) -> DataFrame:
        seen = Observation(f"audit_{len(self._seen)}_{step}")
        self._seen.append((step, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def table(self) -> list[dict]:
        rows, before, first = [], None, None
        for step, seen in self._seen:
            after = seen.get["rows"]
            first = after if first is None else first
            before = after if before is None else before
            rows.append(
                {
                    "step": step,
                    "rows_before": before,
                    "rows_after": after,
                    "removed": before - after,
                    "total_removed": first - after,
                    "removed_pct": round(100.0 * (first - after) / first, 2) if first else 0.0,
                }
            )
            before = after
        return rows


def filter_counts(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, rows_after) for a chain of row filters, from one scan."""
    passed, aggs = F.lit(True), [F.count(F.lit(1)).alias("initial")]
    names = ["initial"]
    for name, keep in steps:
        passed = passed & F.coalesce(keep, F.lit(False))
        aggs.append(F.count_if(passed).alias(name))
        names.append(name)
    return df.agg(*aggs).unpivot([], names, "step", "rows_after")


def clean(
    df: DataFrame,
    audit: CleaningAudit | None = None,
    weekday_mode: str = "overwrite",
    strict_age_bands: bool = False,
) -> DataFrame:
    """The cleaning steps in order. Raises on a table without columns.

    Rows are observed only for an ``audit``: an observer keeps filters from reaching the scan.
    """
    if not df.columns:
        raise ValueError("cannot clean a table without columns")
    mark = (lambda rows, step: rows) if audit is None else audit.mark
    pattern = presets.STRICT_AGE_BAND_PATTERN if strict_age_bands else presets.AGE_BAND_PATTERN
    out = mark(drop_sparse_columns(df), "initial")
    out = mark(filter_valid_set(out), "valid_speed")
    out = mark(require_non_null(out), "required_fields")
    out = fix_day_of_week(out, mode=weekday_mode)
    out = null_if_not_matching(out, pattern=pattern)
    out = recode_with_fallback(out)
    return mark(distinct_rows(out), "distinct")
