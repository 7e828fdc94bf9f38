"""Registered queries with their SQL oracles.

A query names its output as ``column:kind`` pairs (i BIGINT, f DOUBLE at 6 decimals, s text).
Both sides are cast to it, so engines differ in values only where operators differ.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.schema import col
from tarmac.session import skip_huge_methods
from tarmac.sources import domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """Domain views and test tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        skip_huge_methods(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return domain.view(self.spark, self.sf_dir, name)


def parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.rsplit(":", 1)) for part in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    casts = {
        "i": lambda c: c.cast("long"),
        "f": lambda c: F.round(c.cast("double"), 6),
        "s": lambda c: c.cast("string"),
    }
    return df.select(*[casts[kind](col(name)).alias(name) for name, kind in parse(spec)])


def oracle(spec: str, body: str, views: Sequence[str] = ()) -> str:
    casts = {
        "i": 'CAST("{0}" AS BIGINT) AS "{0}"',
        "f": 'round(CAST("{0}" AS DOUBLE), 6) + 0e0 AS "{0}"',
        "s": 'CAST("{0}" AS VARCHAR) AS "{0}"',
    }
    chosen = ", ".join(casts[kind].format(name) for name, kind in parse(spec))
    head = domain.with_views(*views) + "\n" if views else ""
    return f"{head}SELECT {chosen} FROM ({body}) AS result"


def query(name: str, spec: str, body: str | None = None, views: Sequence[str] = ()):
    """Register ``fn(data) -> DataFrame`` under ``name``; without SQL only rows are checked."""

    def add(fn: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: shape(fn(Data(spark, sf_dir)), spec)
        if body is not None:
            ORACLES[name] = oracle(spec, body, views)
        return fn

    return add


def unpivot_sql(table: str, columns: Sequence[str], where: str = "") -> str:
    """(column, value) rows of several columns, for oracle texts."""
    parts = [f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {table} {where}" for c in columns]
    return "(" + " UNION ALL ".join(parts) + ")"


def case_map(value: str, mapping: dict, default: str = "NULL") -> str:
    """CASE over a fixed map, for oracle texts."""
    def lit(x):
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {value} {arms} ELSE {default} END)"
