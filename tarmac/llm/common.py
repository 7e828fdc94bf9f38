"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its plain name, also where the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    return F.coalesce(named(name).cast("string"), F.lit(""))


def fold(key: str, modulus: int) -> Column:
    """crc32 of a key's text, by modulus; null keys take the empty text."""
    return F.pmod(F.crc32(F.coalesce(named(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def scratch_name(df: DataFrame, wanted: str) -> str:
    """``wanted`` or, where the table has such a column, a longer name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def width(df: DataFrame, least: int = 8) -> int:
    """Partitions for a shuffle of known work: the session's, not fewer than ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Memo(dict):
    """Results of ``make`` by key, in bounded memory.

    Only keys of up to ``longest`` characters or bytes are kept (any key where it is None). A full
    table becomes the old one and a new one starts; what is still asked for moves over.
    """

    def __init__(self, make: Callable, entries: int = 1 << 17, longest: int | None = 64) -> None:
        super().__init__()
        self.make, self.entries, self.longest, self.old = make, entries, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if self.longest is not None and len(key) > self.longest:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
