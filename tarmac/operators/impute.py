"""Missing values, outliers, encoding and scaling. Fitted parameters are plain small objects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac import presets
from tarmac.functions import scalar as fx
from tarmac.operators import clean, order_stats, profile
from tarmac.operators.skew import held, join_lookup, join_small_or_large
from tarmac.schema import col, numeric_columns, string_columns
from tarmac.session import cut_lineage

#: Bytes of levels that are broadcast at most.
HELD_BYTES = 8 << 20


def _fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill nulls; a value that does not fit an integer column widens it to double."""
    out = {}
    types = dict(df.dtypes)
    for c, v in values.items():
        if v is None:
            continue
        whole = types[c] in ("int", "bigint", "smallint", "tinyint")
        if whole and float(v) == int(float(v)):
            out[c] = F.coalesce(col(c), F.lit(int(float(v))).cast(types[c]))
        elif whole:
            out[c] = F.coalesce(col(c).cast("double"), F.lit(float(v)))
        else:
            out[c] = F.coalesce(col(c), F.lit(v).cast(types[c]))
    return df.withColumns(out) if out else df


def impute_median_or_unknown(df: DataFrame, unknown: str = "Unknown", **options) -> DataFrame:
    """Numeric nulls become the column median, string nulls become ``unknown``."""
    return _fill(_fill(df, order_stats.medians(df, numeric_columns(df), **options)), {c: unknown for c in string_columns(df)})


def handle_missing(df: DataFrame, max_percent: float = 50.0, keep: Sequence[str] = presets.WEATHER_KEEP) -> DataFrame:
    return impute_median_or_unknown(clean.drop_columns_over_missing(df, max_percent, keep))


def impute_mean(df: DataFrame, columns: Sequence[str] = ("Latitude", "Longitude")) -> DataFrame:
    row = df.agg(*[F.avg(col(c)).alias(c) for c in columns]).first()
    return _fill(df, {c: row[c] for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    found = {r["column"]: r["value"] for r in order_stats.modes(df, columns).collect()}  # one row per column
    return _fill(df, found)


def impute_group_mean(df: DataFrame, column: str = "temp", by: str = "Date") -> DataFrame:
    """Nulls take the mean of their group, if the group has one."""
    means = df.where(col(column).isNotNull() & col(by).isNotNull()).groupBy(col(by)).agg(F.avg(col(column)).alias("_mean"))
    joined = join_small_or_large(df, means, [by])
    return joined.withColumn(column, F.coalesce(col(column).cast("double"), F.col("_mean"))).select(*[col(c) for c in df.columns])


def impute_for_balancing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median for numbers, mode for texts, over the selected features."""
    numbers = [c for c in columns if c in numeric_columns(df)]
    texts = [c for c in columns if c in string_columns(df)]
    out = _fill(df, order_stats.medians(df, numbers)) if numbers else df
    return impute_mode(out, texts) if texts else out


def fill_forward_back(df: DataFrame, columns: Sequence[str], order_by: str, ranges: int | None = None) -> DataFrame:
    """Last non-null value in the given order, then the next one for leading nulls.

    Each order range hands on the last non-null value it holds, so no task sees the whole
    order. Only rows before the first non-null value look forward, and for all of them that
    is the same value. ``order_by`` must identify rows, which also keeps the ranges even: no
    value of it can be hot.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = col(order_by)
    placed = df.withColumn("_range", _range_of(key, _range_limits(df, order_by, ranges)))
    edge_aggs = []
    for c in columns:
        known = F.when(col(c).isNotNull(), key)
        edge_aggs += [F.min_by(col(c), known).alias(f"{c}#first"), F.max_by(col(c), known).alias(f"{c}#last")]
    edges = placed.groupBy("_range").agg(*edge_aggs)  # at most `ranges` rows
    steps = Window.partitionBy(F.lit(0)).orderBy("_range")
    earlier = steps.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = steps.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = edges.select(
        "_range",
        *[F.last(col(f"{c}#last"), ignorenulls=True).over(earlier).alias(f"{c}#before") for c in columns],
        *[F.first(col(f"{c}#first"), ignorenulls=True).over(everywhere).alias(f"{c}#start") for c in columns],
    )
    so_far = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    seen = placed.withColumns({f"{c}#ffill": F.last(col(c), ignorenulls=True).over(so_far) for c in columns})
    joined = seen.join(F.broadcast(carried), "_range", "left")
    filled = {c: F.coalesce(col(f"{c}#ffill"), col(f"{c}#before"), col(f"{c}#start")) for c in columns}
    return joined.select(*[filled[c].alias(c) if c in filled else col(c) for c in df.columns])


def _range_limits(df: DataFrame, column: str, ranges: int) -> list:
    if ranges < 2:
        return []
    probs = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(col(column), probs, 1000).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def _range_of(value, limits: list):
    if not limits:
        return F.lit(0)
    return fx.count_below(F.array(*[F.lit(x) for x in limits]), value)


def impute_ordered(
    df: DataFrame, columns: Sequence[str], order_by: str, max_percent: float = 20.0
) -> DataFrame:
    """Drop columns over the null limit, fill forward then back, then the median; all-null columns go."""
    shares = clean.null_shares(df, columns)
    gone = [c for c in columns if shares[c] * 100 > max_percent or shares[c] >= 1.0]
    kept = [c for c in columns if c not in gone]
    out = df.drop(*gone)
    holed = [c for c in kept if shares[c] > 0]
    if not holed:
        return out
    return _fill(fill_forward_back(out, holed, order_by), order_stats.medians(df, holed))


def outlier_columns(df: DataFrame, exclude: Sequence[str] = presets.ID_COLUMNS) -> list[str]:
    """Numeric columns without nulls, ids and label left out."""
    numbers = numeric_columns(df, exclude)
    if not numbers:
        return []
    shares = clean.null_shares(df, numbers)
    return [c for c in numbers if shares[c] == 0]


def outlier_clip(
    df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5, **options
) -> tuple[DataFrame, DataFrame]:
    """(clipped table, statistics of the affected columns); all fences from the input table."""
    columns = outlier_columns(df) if columns is None else list(columns)
    bounds = profile.fences(df, columns, multiplier, **options)
    clipped = df.withColumns({c: fx.clip(col(c).cast("double"), b[2], b[3]) for c, b in bounds.items()}) if bounds else df
    stats = (
        profile.iqr_outliers(df, columns, multiplier, bounds)
        .where(F.col("outliers") > 0)
        .select(
            "column",
            F.col("outliers").alias("n_outliers"),
            F.round(F.col("outliers") * 100.0 / F.col("n_valid"), 2).alias("pct_outliers"),
            F.round("lower_fence", 3).alias("lower_bound"),
            F.round("upper_fence", 3).alias("upper_bound"),
        )
    )
    return clipped, stats


def outlier_remove(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5, **options) -> DataFrame:
    """Drop rows outside the fences, one column after another.

    Fences of a column come from the rows that the columns before it left, as the semantics
    asks; the loop runs over columns, and each turn adds one filter to the plan.
    """
    out = df
    for c in columns:
        bound = profile.fences(out, [c], multiplier, **options).get(c)
        if bound:
            out = out.where(col(c).between(bound[2], bound[3]))
    return out


def onehot_encode(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """0/1 columns ``column_level`` for every level; null gives 0 in all."""
    text = col(column).cast("string")
    return df.withColumns({f"{column}_{v}": fx.flag(text == v) for v in levels}).drop(column)


def level_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, level) of all different levels of all columns as text, null included, in one pass, written once."""
    entries = F.array(*[F.struct(F.lit(i).alias("column"), col(c).cast("string").alias("level")) for i, c in enumerate(columns)])
    return cut_lineage(df.select(F.explode(entries).alias("e")).select("e.*").distinct())


def codes_by_ranges(levels: DataFrame) -> DataFrame:
    """(level, code) for the rows of (level): codes in text order from 0, counted by ranges, so no task sorts all levels."""
    width = max(8, int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut_lineage(levels.repartitionByRange(width, "level").withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select(
        "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )  # a row per range
    position = F.row_number().over(Window.partitionBy("_range").orderBy("level")) - 1
    coded = placed.join(F.broadcast(offsets), "_range").select("level", (F.col("offset") + position).cast("long").alias("code"))
    return coded


def _with_codes(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    keyed = df.withColumn("_level", F.coalesce(col(column).cast("string"), F.lit("None")))
    joined = join_lookup(keyed, levels.withColumnsRenamed({"level": "_level", "code": "_code"}), ["_level"])
    return joined.select(*[F.col("_code").alias(c) if c == column else col(c) for c in df.columns])


def encode_categorical(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "onehot", max_categories: int = 10, held_bytes: int = HELD_BYTES
) -> DataFrame:
    """One-hot up to ``max_categories`` levels, label codes (in text order from 0, null as 'None') beyond or when asked for.

    One dictionary of all columns comes from one pass. The levels of the smaller columns, up to ``held_bytes`` in all,
    make one broadcast that every such column looks its codes up in; a larger column is coded by
    ranges of its levels and joined by itself.
    """
    names = [c for c in (columns if columns is not None else string_columns(df)) if c in df.columns]
    if not names:
        return df
    table = level_table(df, names)
    size = F.sum(F.coalesce(F.octet_length("level"), F.lit(0)) + 16)
    told = table.groupBy("column").agg(F.count("level").alias("levels"), size.alias("bytes")).collect()  # a row per column
    stats = dict.fromkeys(range(len(names)), (0, 0)) | {r["column"]: (r["bytes"], r["levels"]) for r in told}
    small, room = [], held_bytes
    for i in sorted(stats, key=lambda i: (stats[i][0], i)):
        if stats[i][0] > room:
            break
        room -= stats[i][0]
        small.append(i)
    levels: dict[int, list[str | None]] = {i: [] for i in small}
    for r in table.where(F.col("column").isin(small)).collect():  # held_bytes at most
        levels[r["column"]].append(r["level"])
    onehot = {i for i in small if method == "onehot" and stats[i][1] <= max_categories}
    codes = []
    for i in set(small) - onehot:
        codes += [(f"{i}:{v}", n) for n, v in enumerate(sorted({"None" if v is None else v for v in levels[i]}))]
    out = df
    if len(onehot) < len(small):
        # One key for all columns, so that their joins share one broadcast.
        shared = df.sparkSession.createDataFrame(codes, "_key string, _code long")
        for i, c in enumerate(names):
            if i in levels and i not in onehot:
                key = F.concat(F.lit(f"{i}:"), F.coalesce(col(c).cast("string"), F.lit("None")))
                joined = out.withColumn("_at", key).join(F.broadcast(shared), F.col("_at") == F.col("_key"), "left")
                out = joined.select(*[F.col("_code").alias(x) if x == c else col(x) for x in out.columns])
    for i, c in enumerate(names):
        if i in onehot:
            out = onehot_encode(out, c, sorted(v for v in levels[i] if v is not None))
        elif i not in levels:
            own = table.where(F.col("column") == i).select(F.coalesce("level", F.lit("None")).alias("level")).distinct()
            out = _with_codes(out, c, codes_by_ranges(own))
    return out


def label_encode(df: DataFrame, column: str, held_bytes: int = HELD_BYTES) -> DataFrame:
    return encode_categorical(df, [column], "label", held_bytes=held_bytes)


@dataclass
class Scaler:
    """(x − mean) / population deviation; a constant column keeps divisor 1; nulls become 0."""

    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> Scaler:
        row = df.agg(
            *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        return Scaler(
            {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)},
            {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)},
        )

    def transform(self, df: DataFrame, fill_null: float | None = 0.0) -> DataFrame:
        def scaled(c):
            value = (col(c).cast("double") - self.mean[c]) / self.std[c]
            return value if fill_null is None else F.coalesce(value, F.lit(fill_null))

        return df.withColumns({c: scaled(c) for c in self.mean})
