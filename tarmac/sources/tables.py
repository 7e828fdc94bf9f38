"""Readers: CSV with an explicit schema, relational tables, station weather, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from tarmac.schema import col, nan_to_null, sanitize_columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Header row, Latin-1, explicit schema; a value that does not fit its type is null."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
    return sanitize_columns(nan_to_null(_or_fail(lambda: reader.schema(schema).csv(path), path)))


def read_csv_as_text(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """All columns as text, names from the header; cast with ``clean.to_numeric`` where needed."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False)
    return sanitize_columns(_or_fail(lambda: reader.csv(path), path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _or_fail(lambda: spark.read.parquet(path), path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """One record per line, so files split over tasks; ``multi_line`` reads one record or array per file in one task."""
    reader = spark.read.option("multiLine", multi_line)
    return _or_fail(lambda: (reader.schema(schema) if schema else reader).json(path), path)


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    columns: Sequence[str],
    predicate: Column | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    num_partitions: int = 1,
    **options,
) -> DataFrame:
    """A relational table over JDBC; the filter and the columns reach the source.

    With ``partition_column`` (a number, date or timestamp) and its ``bounds``, that many tasks read
    a range each; rows beyond the bounds fall to the first and the last. Without them one task reads all.
    """
    if partition_column is not None:
        if bounds is None or num_partitions < 2:
            raise ValueError("a partition column needs bounds and at least 2 partitions")
        low, high = bounds
        options |= {"partitionColumn": partition_column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(num_partitions)}
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return project(df, columns, predicate)


def project(df: DataFrame, columns: Sequence[str], predicate: Column | None = None) -> DataFrame:
    out = df if predicate is None else df.where(predicate)
    return out.select(*[col(c) for c in columns])


def require_inputs(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """Open every input or fail naming the one that is absent."""
    return [read_parquet(spark, p) for p in paths]


def _or_fail(open_it, path: str) -> DataFrame:
    try:
        return open_it()
    except AnalysisException as error:
        raise FileNotFoundError(f"input not readable: {path}: {error.getCondition() or error}") from error
