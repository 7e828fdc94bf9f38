"""Column contract: quoting, safe names, missing-column modes, NaN handling."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ON_MISSING = ("skip", "constant", "error")


def col(name: str) -> Column:
    """Column reference that survives dots and brackets in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_name(name: str) -> str:
    """Letters, digits and underscores only; a leading digit gets an ``X``."""
    clean = re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_")
    return "X" + clean if clean[:1].isdigit() else clean


def sanitize_columns(df: DataFrame) -> DataFrame:
    names = [safe_name(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide after cleaning: {names}")
    return df.toDF(*names)


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def guard(df: DataFrame, names: Iterable[str], on_missing: str) -> bool:
    """True when every column is there; ``error`` mode raises otherwise."""
    if on_missing not in ON_MISSING:
        raise ValueError(f"on_missing must be one of {ON_MISSING}")
    if on_missing == "error":
        require(df, names)
    return set(names) <= set(df.columns)


def nan_to_null(df: DataFrame) -> DataFrame:
    """The domain has one notion of missing; NaN joins it at ingest."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: F.when(~F.isnan(col(n)), col(n)) for n in floats}) if floats else df


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def select_numeric(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Numeric columns plus ``keep``; strings, dates and timestamps go."""
    wanted = set(numeric_columns(df)) | set(keep)
    return df.select(*[col(c) for c in df.columns if c in wanted])
