"""Dashboard and exploratory roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac import presets
from tarmac.functions import scalar as fx
from tarmac.operators import order_stats
from tarmac.schema import col


def severe_flag(df: DataFrame, label: str = "Accident_Severity", severe: Sequence[str] = presets.SEVERE_LABELS) -> DataFrame:
    return df.withColumn("SevereFlag", fx.is_member(label, severe).cast("double"))


def attach_labels(features: DataFrame, labels: DataFrame, key: str, label: str = "Accident_Severity") -> DataFrame:
    """Features with their label and severe flag, matched by key and never by position."""
    return severe_flag(features.join(labels.select(col(key), col(label)), key), label)


def severe_rate_by(df: DataFrame, group: str, min_rows: int | None = None) -> DataFrame:
    """(group, Accidents, SevereRate), groups with more than ``min_rows`` rows."""
    out = df.where(col(group).isNotNull()).groupBy(col(group)).agg(
        F.count(F.lit(1)).alias("Accidents"), F.avg("SevereFlag").alias("SevereRate")
    )
    return out if min_rows is None else out.where(F.col("Accidents") > min_rows)


def top_groups(df: DataFrame, group: str, n: int = 10) -> DataFrame:
    """The ``n`` largest groups, smallest of them first."""
    return severe_rate_by(df, group).orderBy(F.desc("Accidents"), col(group)).limit(n).orderBy("Accidents", col(group))


def mean_by_category(df: DataFrame, category: str, target: str) -> DataFrame:
    return df.where(col(category).isNotNull()).groupBy(col(category)).agg(F.avg(col(target)).alias("mean"))


def quantile_bin(value: Column, edges: Sequence[float]) -> Column:
    """Bin id of (e0,e1], …, the first bin closed on the left, from sorted distinct edges."""
    inner = [float(e) for e in edges[1:-1]]
    above = F.lit(0)
    for e in inner:
        above = above + (value > e).cast("int")
    inside = (value >= float(edges[0])) & (value <= float(edges[-1]))
    return F.when(inside, above)


def quantile_edges(df: DataFrame, column: str, q: int = 10, **options) -> list[float]:
    """Quantile limits with repeats removed; a constant column gives one edge only."""
    found = order_stats.exact_quantiles(df, [column], [i / q for i in range(q + 1)], **options)[column]
    return sorted({e for e in found if e is not None})


def severe_rate_by_decile(df: DataFrame, column: str = "road_risk_score", q: int = 10, **options) -> DataFrame:
    """(RiskDecile from 1, Accidents, SevereRate) over quantile bins."""
    edges = quantile_edges(df, column, q, **options)
    if len(edges) < 2:
        return df.limit(0).select(F.lit(1).alias("RiskDecile"), F.lit(0).cast("long").alias("Accidents"), F.lit(0.0).alias("SevereRate"))
    binned = df.where(col(column).isNotNull()).withColumn("RiskDecile", quantile_bin(col(column), edges) + 1)
    return severe_rate_by(binned, "RiskDecile")


def upper_tail_trim(df: DataFrame, column: str, share: float = 0.99, **options) -> DataFrame:
    """Rows with a positive value up to the given quantile of the positive values."""
    positive = df.where(col(column) > 0)
    limit = order_stats.exact_quantiles(positive, [column], [share], **options)[column][0]
    return positive.where(col(column) <= limit) if limit is not None else positive


def engine_band_by_severity(
    df: DataFrame, column: str = "Engine_Capacity_CC", label: str = "Accident_Severity", bands: int = 8, **options
) -> DataFrame:
    """(band, band_start, band_end, label, Count) over equal-width right-closed bands, tail trimmed."""
    kept = upper_tail_trim(df.where(col(label).isNotNull()), column, **options)
    box = kept.agg(F.min(col(column)).cast("double").alias("lo"), F.max(col(column)).cast("double").alias("hi")).first()
    if box["lo"] is None:
        return df.limit(0).select(F.lit(0).alias("band"), F.lit(0.0).alias("band_start"), F.lit(0.0).alias("band_end"), col(label), F.lit(0).cast("long").alias("Count"))
    width = (box["hi"] - box["lo"]) / bands
    raw = F.ceil((col(column) - box["lo"]) / width) - 1 if width else F.lit(0)
    band = F.greatest(F.lit(0), F.least(F.lit(bands - 1), raw)).cast("int")
    return (
        kept.withColumn("band", band)
        .groupBy("band", col(label))
        .agg(F.count(F.lit(1)).alias("Count"))
        .select(
            "band",
            (F.lit(box["lo"]) + F.lit(width) * F.col("band")).alias("band_start"),
            (F.lit(box["lo"]) + F.lit(width) * (F.col("band") + 1)).alias("band_end"),
            col(label),
            "Count",
        )
    )


def in_order(value: Column, order: Sequence[str]) -> Column:
    """Sort key for a fixed category order."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), value)


def severity_share(df: DataFrame, label: str = "Accident_Severity", order: Sequence[str] = presets.LABELS) -> DataFrame:
    """(Severity, Count, Share, position) over the listed classes, in their order."""
    counts = df.where(fx.is_member(label, order)).groupBy(col(label).alias("Severity")).agg(F.count(F.lit(1)).alias("Count"))
    # One row per class.
    share = F.col("Count") / F.sum("Count").over(Window.partitionBy(F.lit(0)))
    return counts.select("Severity", "Count", share.alias("Share"), in_order(F.col("Severity"), order).alias("position")).orderBy("position")


def dashboard_kpis(df: DataFrame, label: str = "Accident_Severity", group: str = "Speed_limit") -> DataFrame:
    """One row: totals, severe share, and the group with most rows (smallest group on ties)."""
    by_group = df.groupBy(col(group).alias("g")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(col(label) == "Fatal").alias("fatal"),
        F.count_if(col(label) == "Serious").alias("serious"),
    )
    return by_group.agg(
        F.sum("n").alias("total"),
        F.sum("fatal").alias("fatal"),
        F.sum("serious").alias("serious"),
        (F.sum(F.col("fatal") + F.col("serious")) / F.sum("n")).alias("severe_share"),
        F.max_by("g", F.when(F.col("g").isNotNull(), F.struct("n", (-F.col("g")).alias("tie")))).alias("peak_group"),
    )


def split_totals(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """(split, label, n, pct within the split)."""
    counts = df.groupBy(col(split).alias("split"), col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("split")))


PERIODS = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "year": "interval 1 year"}


def period_start(day: Column, period: str) -> Column:
    """First day of the period; weeks run Monday to Sunday."""
    return day.cast("date") if period == "day" else F.trunc(day.cast("date"), period)


def period_label(start: Column, period: str) -> Column:
    """The day a period is named by: weeks and months by their last day."""
    if period == "week":
        return F.date_add(start, 6)
    if period == "month":
        return F.last_day(start)
    return start


def calendar_counts(df: DataFrame, day: str, period: str) -> DataFrame:
    """(period, n) for every calendar period between the first and the last, empty ones as 0."""
    counts = (
        df.where(col(day).isNotNull())
        .groupBy(period_start(col(day), period).alias("start"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spine = counts.agg(F.min("start").alias("a"), F.max("start").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr(PERIODS[period]))).alias("start")
    )
    return spine.join(counts, "start", "left").select(
        period_label(F.col("start"), period).alias("period"), F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def rolling_mean(periods: DataFrame, window: int = 10) -> DataFrame:
    """Trailing mean over ``window`` periods, null until there are that many.

    The input has one row per calendar period, a few thousand at most, so one ordered
    window is enough.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("period").rowsBetween(-(window - 1), 0)
    return periods.withColumn("rolling_mean", F.when(F.count("n").over(w) == window, F.avg("n").over(w)))


def weekday_average(df: DataFrame, day: str) -> DataFrame:
    """(weekday, position, mean) of daily counts, Monday first, empty days included."""
    days = calendar_counts(df, day, "day")
    return (
        days.groupBy(F.weekday("period").alias("position"))
        .agg(F.avg("n").alias("mean"))
        .select(fx.pick_label(F.col("position"), presets.WEEKDAYS).alias("weekday"), "position", "mean")
        .orderBy("position")
    )


def hour_histogram(df: DataFrame, hour: Column) -> DataFrame:
    """(hour, n) for all 24 hours."""
    counts = df.select(hour.alias("hour")).where(F.col("hour").between(0, 23)).groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return F.broadcast(spine).join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def daypart_counts(df: DataFrame, hour: Column) -> DataFrame:
    return df.where(hour.isNotNull()).groupBy(fx.daypart(hour).alias("daypart")).agg(F.count(F.lit(1)).alias("n"))
