"""Row-local expressions. All are built-in functions, so they stay in code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def as_column(value: Column | str) -> Column:
    return F.col("`" + value + "`") if isinstance(value, str) else value


def flag(condition: Column) -> Column:
    """0/1 with an unknown condition counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def differs_flag(value: Column | str, expected: str) -> Column:
    """1 unless equal; null differs from every value."""
    return (~as_column(value).eqNullSafe(F.lit(expected))).cast("int")


def contains_any(value: Column | str, words: Sequence[str]) -> Column:
    column = as_column(value)
    test = F.lit(False)
    for word in words:
        test = test | column.contains(word)
    return F.coalesce(test, F.lit(False))


def is_member(value: Column | str, members: Sequence) -> Column:
    """Set membership where null is not a member (never null itself)."""
    return F.coalesce(as_column(value).isin(*members), F.lit(False))


def matches(value: Column | str, pattern: str) -> Column:
    """Regex test; null does not match."""
    return F.coalesce(as_column(value).rlike(pattern), F.lit(False))


def capitalized(value: Column | str) -> Column:
    """Trim, first letter upper, the rest lower (one word, not every word)."""
    text = F.trim(as_column(value))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1_000_000)))


def lookup(value: Column | str, mapping: Mapping, default=None) -> Column:
    """Fixed small map as a literal; a miss or a null gives ``default``."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), as_column(value))
    return found if default is None else F.coalesce(found, F.lit(default))


def to_number(value: Column | str) -> Column:
    """Numeric reading of anything; what cannot be read is null, never an error."""
    return as_column(value).try_cast("double")


def to_day(value: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(as_column(value), fmt)


def hour_of_time(value: Column | str) -> Column:
    """Hour of an ``HH:MM`` text; null when it is not a number."""
    return F.substring(as_column(value), 1, 2).try_cast("int")


def day_name(value: Column | str) -> Column:
    return F.date_format(as_column(value), "EEEE")


def season(month: Column | str) -> Column:
    m = as_column(month)
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.between(3, 5), "Spring")
        .when(m.between(6, 8), "Summer")
        .when(m.between(9, 11), "Autumn")
    )


def daypart(hour: Column | str) -> Column:
    """Five named parts of the day; all other hours, and null, are night."""
    h = as_column(hour)
    return (
        F.when(h.between(5, 9), "morning rush (5-10)")
        .when(h.between(10, 14), "office hours (10-15)")
        .when(h.between(15, 18), "afternoon rush (15-19)")
        .when(h.between(19, 22), "evening (19-23)")
        .otherwise("night (23-5)")
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def right_closed_bin(value: Column | str, edges: Sequence[float], otherwise: int = -1) -> Column:
    """Bin id for (e0,e1], (e1,e2], … ; the last edge may be infinity."""
    column = as_column(value)
    low = edges[0]
    chosen = None
    for index, high in enumerate(edges[1:]):
        test = column > F.lit(float(low))
        if high != float("inf"):
            test = test & (column <= F.lit(float(high)))
        chosen = F.when(test, index) if chosen is None else chosen.when(test, index)
        low = high
    return chosen.otherwise(otherwise)


def clip(value: Column | str, low: float, high: float) -> Column:
    column = as_column(value)
    return F.when(column < low, F.lit(low)).when(column > high, F.lit(high)).otherwise(column)


def safe_sqrt(value: Column | str) -> Column:
    """Square root; negative input is missing, not NaN."""
    column = as_column(value)
    return F.when(column >= 0, F.sqrt(column))


def truncated(value: Column) -> Column:
    """Integer part toward zero."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("int")


def count_below(limits: Column, value: Column) -> Column:
    """How many entries of a sorted array are smaller than a value, by binary search; null counts none."""
    def longer(at: Column, bit: Column) -> Column:
        step = at + F.call_function("shiftleft", F.lit(1), bit)
        # Past the end there is no entry, so nothing that is smaller.
        return F.when(F.coalesce(F.get(limits, step - 1) < value, F.lit(False)), step).otherwise(at)

    bits = F.sequence(F.ceil(F.log2(F.size(limits) + 1)).cast("int"), F.lit(0), F.lit(-1))
    return F.aggregate(bits, F.lit(0), longer)


def stable_hash(key: Column, seed: int = 42) -> Column:
    """60-bit hash of a key, equal on every engine that has md5.

    It depends on the key and the seed alone, so a draw made with it is the same
    whatever the partitioning, and the same again after a task is retried.
    """
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


HASH_RANGE = float(1 << 60)


def unit_hash(key: Column, seed: int = 42) -> Column:
    """``stable_hash`` scaled to [0, 1)."""
    return stable_hash(key, seed) / F.lit(HASH_RANGE)


def chosen_index(probabilities: Column, thresholds: Sequence[Column | float]) -> Column:
    """Index of the largest margin over its threshold, lowest index on ties.

    Rows in which no class clears its threshold take the most probable class.
    """
    n = len(thresholds)
    p = [probabilities[i] for i in range(n)]
    t = [x if isinstance(x, Column) else F.lit(float(x)) for x in thresholds]
    margins = [p[i] - t[i] for i in range(n)]
    return F.when(F.greatest(*margins) > 0, argmax(margins)).otherwise(argmax(p))


def argmax(values: Sequence[Column]) -> Column:
    """Position of the largest value; the first one on ties."""
    top = F.greatest(*values)
    chosen = F.when(values[0] == top, 0)
    for index, value in enumerate(values[1:], start=1):
        chosen = chosen.when(value == top, index)
    return chosen


def pick_label(index: Column, labels: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), index + 1)


def probability_map(probabilities: Column, labels: Sequence[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), probabilities)
