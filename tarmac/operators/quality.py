"""Data-quality checks. Each check is one or more rows of a long findings table:

(dimension, check_name, subject, metric, value, detail, is_issue)

Checks on one table fold into a single aggregate, so the table is scanned once however many
checks run. A check whose column is absent leaves a SKIP row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac import presets
from tarmac.functions import scalar as fx
from tarmac.operators import correlation, joins, profile
from tarmac.operators.skew import row_fingerprint
from tarmac.schema import col, numeric_columns

FINDINGS = "dimension string, check_name string, subject string, metric string, value double, detail string, is_issue boolean"


class Checks:
    """Collects counting expressions over one table and emits them as findings."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df
        self._aggs: list[Column] = []
        self._rows: list[tuple] = []

    def has(self, dimension: str, check: str, *columns: str) -> bool:
        missing = [c for c in columns if c not in self.df.columns]
        if missing:
            self._rows.append((dimension, check, ",".join(columns), "skipped", F.lit(None), "SKIP missing " + ",".join(missing), F.lit(False)))
        return not missing

    def measure(self, dimension: str, check: str, subject: str, metric: str, value: Column, issue: bool = True, detail: str | None = None) -> None:
        name = f"a{len(self._aggs)}"
        self._aggs.append(value.cast("double").alias(name))
        found = F.coalesce(F.col(name) > 0, F.lit(False)) if issue else F.lit(False)
        self._rows.append((dimension, check, subject, metric, F.col(name), detail, found))

    def findings(self) -> DataFrame:
        aggs = self._aggs or [F.count(F.lit(1)).alias("unused")]
        entries = F.array(
            *[
                F.struct(
                    F.lit(d).alias("dimension"),
                    F.lit(c).alias("check_name"),
                    F.lit(s).alias("subject"),
                    F.lit(m).alias("metric"),
                    v.cast("double").alias("value"),
                    F.lit(t).cast("string").alias("detail"),
                    i.alias("is_issue"),
                )
                for d, c, s, m, v, t, i in self._rows
            ]
        )
        return self.df.agg(*aggs).select(F.explode(entries).alias("e")).select("e.*")


def check_accuracy(accidents: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Domains and bounds of both tables (severity, speed, place, counts, age, weekday, sex)."""
    a, dim = Checks(accidents), "accuracy"
    if a.has(dim, "severity_domain", "Accident_Severity"):
        bad = ~fx.is_member(col("Accident_Severity").cast("string"), presets.SEVERITY_DOMAIN)
        a.measure(dim, "severity_domain", "Accident_Severity", "invalid", F.count_if(bad))
    if a.has(dim, "speed_domain", "Speed_limit"):
        a.measure(dim, "speed_domain", "Speed_limit", "invalid", F.count_if(~fx.to_number("Speed_limit").isin(*map(float, presets.SPEED_LIMITS))))
    if a.has(dim, "coordinate_bounds", "Latitude", "Longitude"):
        for name, (low, high) in (("Latitude", presets.LATITUDE_BOUNDS), ("Longitude", presets.LONGITUDE_BOUNDS)):
            value = fx.to_number(name)
            a.measure(dim, "coordinate_bounds", name, "out_of_bounds", F.count_if((value < low) | (value > high)))
    if a.has(dim, "vehicle_count", "Number_of_Vehicles"):
        a.measure(dim, "vehicle_count", "Number_of_Vehicles", "non_positive", F.count_if(fx.to_number("Number_of_Vehicles") <= 0))
    if a.has(dim, "weekday_domain", "Day_of_Week"):
        a.measure(dim, "weekday_domain", "Day_of_Week", "invalid", F.count_if(~fx.is_member("Day_of_Week", presets.WEEKDAYS)))
    v = Checks(vehicles)
    if v.has(dim, "vehicle_age", "Age_of_Vehicle"):
        v.measure(dim, "vehicle_age", "Age_of_Vehicle", "negative", F.count_if(fx.to_number("Age_of_Vehicle") < 0))
    if v.has(dim, "sex_domain", "Sex_of_Driver"):
        v.measure(dim, "sex_domain", "Sex_of_Driver", "invalid", F.count_if(~fx.is_member(fx.capitalized("Sex_of_Driver"), presets.SEX_DOMAIN)))
    if v.has(dim, "age_bands", "Age_Band_of_Driver"):
        v.measure(dim, "age_bands", "Age_Band_of_Driver", "distinct", F.count_distinct(col("Age_Band_of_Driver")), issue=False)
    return a.findings().unionByName(v.findings())


def age_band_sample(vehicles: DataFrame, column: str = "Age_Band_of_Driver", n: int = 10) -> DataFrame:
    """The first ``n`` bands in text order, for the report."""
    return vehicles.where(col(column).isNotNull()).select(col(column)).distinct().orderBy(col(column)).limit(n)


def check_consistency(accidents: DataFrame, vehicles: DataFrame, date: str = "Date") -> DataFrame:
    """Dates parse, year and weekday agree with the date, times are well formed, tables agree."""
    a, dim = Checks(accidents), "consistency"
    if date in accidents.columns:
        is_text = isinstance(accidents.schema[date].dataType, T.StringType)
        parsed = fx.to_day(date) if is_text else col(date)
        a.measure(dim, "date_parses", date, "failures", F.count_if(parsed.isNull() & col(date).isNotNull()))
        if a.has(dim, "year_matches_date", "Year"):
            agrees = F.coalesce(F.year(parsed) == fx.to_number("Year"), F.lit(False))
            a.measure(dim, "year_matches_date", "Year", "mismatches", F.count_if(~agrees))
        if a.has(dim, "weekday_matches_date", "Day_of_Week"):
            agrees = F.coalesce(fx.day_name(parsed) == col("Day_of_Week"), F.lit(False))
            a.measure(dim, "weekday_matches_date", "Day_of_Week", "mismatches", F.count_if(~agrees), issue=False, detail="WARN")
    else:
        a.has(dim, "date_parses", date)
    if a.has(dim, "time_format", "Time"):
        a.measure(dim, "time_format", "Time", "malformed", F.count_if(~col("Time").rlike(presets.TIME_PATTERN)))
    out = a.findings()
    if "Year" in accidents.columns and "Year" in vehicles.columns:
        cross = joins.cross_table_mismatch(accidents, vehicles)
        out = out.unionByName(_single(cross, dim, "year_across_tables", "Year", {"mismatches": True}))
    return out


def check_completeness(
    accidents: DataFrame, vehicles: DataFrame, required: Sequence[str] = presets.CRITICAL_COLUMNS, advice_over: float = 50.0
) -> DataFrame:
    """Null share of every column with nulls; required columns are issues, half-empty ones advice."""
    parts = []
    for name, df in (("accidents", accidents), ("vehicles", vehicles)):
        found = profile.null_profile(df)
        is_required = F.col("column").isin(*required)
        parts.append(
            found.select(
                F.lit("completeness").alias("dimension"),
                F.lit("missing").alias("check_name"),
                F.concat(F.lit(name + "."), F.col("column")).alias("subject"),
                F.lit("pct_null").alias("metric"),
                F.col("pct").alias("value"),
                F.when(is_required, "REQUIRED").when(F.col("pct") > advice_over, "ADVICE drop").alias("detail"),
                is_required.alias("is_issue"),
            )
        )
    return parts[0].unionByName(parts[1])


def check_uniqueness(merged: DataFrame, composite: Sequence[str] = ("Accident_Index", "Vehicle_Reference")) -> DataFrame:
    counts = profile.duplicate_counts(merged, composite, composite[0])
    return _single(
        counts, "uniqueness", "duplicates", "merged",
        {"full_duplicates": True, "composite_duplicates": True, "key_repeats": False},
    )


def check_outliers(accidents: DataFrame, vehicles: DataFrame, isolation: bool = True, **forest_options) -> DataFrame:
    """IQR outliers of the numeric columns, and the multivariate anomaly rate. Flags only."""
    from tarmac.operators import isolation as forest

    parts = []
    wanted = {
        "accidents": (accidents, ["Speed_limit", "Number_of_Casualties", "Number_of_Vehicles"]),
        "vehicles": (vehicles, ["Age_of_Vehicle", "Engine_Capacity_CC"]),
    }
    for name, (df, columns) in wanted.items():
        columns = [c for c in columns if c in df.columns]
        if not columns:
            continue
        metrics = ["iqr_outliers", "lower_fence", "upper_fence"]
        found = profile.iqr_outliers(df, columns).withColumnRenamed("outliers", "iqr_outliers")
        tall = found.select("column", *[F.round(F.col(m).cast("double"), 2).alias(m) for m in metrics])
        tall = tall.unpivot("column", metrics, "metric", "value")
        parts.append(_tall(tall, "outliers", "iqr", name, F.col("metric"), F.col("value")))
        if isolation and len(columns) >= 2:
            keys = [c for c in ("Accident_Index", "Vehicle_Reference") if c in df.columns]
            rate = forest.anomaly_rate(df, columns, keys, **forest_options)
            if rate is not None:
                parts.append(_single(rate, "outliers", "isolation_forest", name, {"sample_size": False, "anomalies": False, "rate_pct": False}))
    return reduce(DataFrame.unionByName, parts)


def check_timeliness(accidents: DataFrame, date: str = "Date", first_day: str = presets.FIRST_YEAR, today: str | None = None) -> DataFrame:
    """Date span (as days since 1970), future dates, dates before the first expected day."""
    a, dim = Checks(accidents), "timeliness"
    if a.has(dim, "date_span", date):
        is_text = isinstance(accidents.schema[date].dataType, T.StringType)
        day = fx.to_day(date) if is_text else col(date).cast("date")
        a.measure(dim, "date_span", date, "earliest_day", F.unix_date(F.min(day)), issue=False)
        a.measure(dim, "date_span", date, "latest_day", F.unix_date(F.max(day)), issue=False)
        now = F.current_date() if today is None else F.lit(today).cast("date")
        a.measure(dim, "future_dates", date, "rows", F.count_if(day > now))
        a.measure(dim, "early_dates", date, "rows", F.count_if(day < F.lit(first_day).cast("date")))
    return a.findings()


def check_distribution(
    df: DataFrame,
    name: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    dimension: str = "distribution",
    sample_key: str | None = None,
) -> DataFrame:
    """Statistics, histogram counts, normality and category frequencies as findings.

    Normality is tested on all rows, where nearly every column of a large table departs from
    it. With ``sample_key`` a test on a fixed-size random sample is reported as well.
    """
    from tarmac.operators import normality

    numeric = [c for c in numeric if c in df.columns]
    categorical = [c for c in categorical if c in df.columns]
    parts = []
    if numeric:
        stats = profile.descriptive_stats(df, numeric)
        metrics = [c for c in stats.columns if c != "column"]
        tall = stats.select("column", *[F.round(F.col(m).cast("double"), 3).alias(m) for m in metrics]).unpivot("column", metrics, "metric", "value")
        parts.append(_tall(tall, dimension, "descriptive_stats", name, F.col("metric"), F.col("value")))
        bins = profile.histogram(df, numeric)
        parts.append(
            _tall(bins, dimension, "histogram", name, F.concat(F.lit("bin_"), F.col("bin").cast("string")), F.col("n").cast("double"))
        )
        tests = [("ks_normal", normality.ks_normal(df, numeric))]
        if sample_key is not None:
            tests += [("ks_normal_sampled", normality.ks_normal_sampled(df, c, sample_key)) for c in numeric]
        for check, found in tests:
            reading = F.when(F.col("is_normal") == 1, "normal").otherwise("not normal")
            rounded = found.select("column", reading.alias("reading"), *[F.round(m, 3).alias(m) for m in ("statistic", "p_value")])
            tall = rounded.unpivot(["column", "reading"], ["statistic", "p_value"], "metric", "value")
            parts.append(_tall(tall, dimension, check, name, F.col("metric"), F.col("value"), F.col("reading")))
    if categorical:
        parts.append(
            _tall(profile.value_counts(df, categorical), dimension, "value_counts", name, F.col("value"), F.col("n").cast("double"))
        )
    return reduce(DataFrame.unionByName, parts)


def check_relationships(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs with Pearson, Spearman and their difference; strong pairs are issues."""
    columns = [c for c in columns if c in df.columns]
    pairs = correlation.compare_correlations(df, columns)
    tall = pairs.unpivot(["left", "right", "is_non_linear", "is_issue"], ["pearson", "spearman", "diff"], "metric", "value")
    return tall.select(
        F.lit("relationships").alias("dimension"),
        F.lit("correlation").alias("check_name"),
        F.concat_ws(" x ", "left", "right").alias("subject"),
        "metric",
        "value",
        F.when(F.col("is_non_linear") == 1, "non-linear").alias("detail"),
        # One issue per pair, carried by its Pearson row.
        ((F.col("is_issue") == 1) & (F.col("metric") == "pearson")).alias("is_issue"),
    )


def check_join_integrity(left: DataFrame, right: DataFrame, key: str = "Accident_Index") -> DataFrame:
    found = joins.join_integrity(left, right, key)
    metrics = {c: c in ("only_left", "only_right") for c in found.columns}
    return _single(found, "join_integrity", "keys", key, metrics)


def check_weather(
    df: DataFrame,
    columns: Sequence[str] = presets.WEATHER_COLUMNS,
    bounds: Mapping[str, tuple] = presets.WEATHER_BOUNDS,
    missing_over: float = 20.0,
) -> DataFrame:
    """Missing share over the limit and values outside physical bounds, one pass for all columns; then their profile."""
    checks, dim = Checks(df), "weather_distribution"
    rows = F.count(F.lit(1))
    for name in columns:
        if not checks.has(dim, "weather_missing", name):
            continue
        value = fx.to_number(name)
        pct = F.round(F.count_if(value.isNull()) * 100.0 / rows, 2)
        checks.measure(dim, "weather_missing", name, "pct_null", pct, issue=False)
        over = F.count_if(value.isNull()) * 100.0 / rows > missing_over
        checks.measure(dim, "weather_missing", name, "over_limit", over.cast("int"))
        if name in bounds:
            low, high = bounds[name]
            checks.measure(dim, "physical_bounds", name, "out_of_bounds", F.count_if((value < low) | (value > high)))
    present = [c for c in columns if c in df.columns]
    if not present:
        return checks.findings()
    return checks.findings().unionByName(check_distribution(df, "weather", present, dimension=dim))


def generic_checks(
    df: DataFrame, longitude_bounds: tuple = presets.GENERIC_LONGITUDE_BOUNDS, max_casualties: int = presets.MAX_CASUALTIES
) -> DataFrame:
    """Ranges, severity domain and casualty count of one table; rows violating each rule."""
    checks, dim = Checks(df), "generic"
    for name, (low, high) in (("Latitude", presets.LATITUDE_BOUNDS), ("Longitude", longitude_bounds)):
        if checks.has(dim, "range", name):
            value = fx.to_number(name)
            checks.measure(dim, "range", name, "violations", F.count_if((value < low) | (value > high)))
    if checks.has(dim, "range", "Speed_limit"):
        checks.measure(dim, "range", "Speed_limit", "violations", F.count_if(~fx.to_number("Speed_limit").isin(*map(float, presets.SPEED_LIMITS))))
    if checks.has(dim, "business_rule", "Accident_Severity"):
        checks.measure(dim, "business_rule", "Accident_Severity", "violations", F.count_if(~fx.is_member("Accident_Severity", presets.LABELS)))
    if checks.has(dim, "business_rule", "Number_of_Casualties"):
        checks.measure(dim, "business_rule", "Number_of_Casualties", "violations", F.count_if(col("Number_of_Casualties") > max_casualties))
    return checks.findings()


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types; metadata only."""
    return list(df.dtypes)


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    return sorted(set(expected) - set(df.columns))


def validation_score(df: DataFrame | None) -> DataFrame:
    """One row: records, columns, issues and max(0, 1 − issues / (records + columns)).

    Issues are columns with nulls, columns with range violations, surplus copies of rows and
    violated business rules.
    """
    if df is None:
        raise ValueError("dataset cannot be None")
    if not df.columns:
        raise ValueError("dataset has no columns")
    width = len(df.columns)
    with_nulls = profile.null_profile(df).agg(F.count(F.lit(1)).alias("n"))
    broken = generic_checks(df).where("is_issue").agg(F.count(F.lit(1)).alias("n"))
    copies = (
        df.select(*row_fingerprint(df.columns))
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("k"))
        .agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("rows"))
    )
    zero = F.lit(0).cast("long")
    parts = (
        with_nulls.select("n", zero.alias("rows"))
        .unionByName(broken.select("n", zero.alias("rows")))
        .unionByName(copies.select("n", "rows"))
    )
    total = parts.agg(F.sum("n").alias("issues_found"), F.sum("rows").alias("total_records"))
    score = F.when(F.col("total_records") == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), 1 - F.col("issues_found") / (F.col("total_records") + width))
    )
    return total.select("total_records", F.lit(width).cast("long").alias("total_columns"), "issues_found", score.alias("validation_score"))


def issues_per_dimension(findings: DataFrame) -> DataFrame:
    return findings.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("is_issue")).alias("issues")
    )


def check_split(df: DataFrame, features: Sequence[str] | None = None, label: str = "label", limit: float = 3.5) -> DataFrame:
    """After split and scaling: values outside ±limit, nulls, copies of feature rows, class balance."""
    features = list(features or numeric_columns(df, [label]))
    checks, dim = Checks(df), "post_split"
    for c in features:
        checks.measure(dim, "z_score", c, "out_of_bounds", F.count_if(F.abs(col(c)) > limit))
        checks.measure(dim, "nulls", c, "rows", F.count_if(col(c).isNull()))
    checks.measure(dim, "label", label, "nulls", F.count_if(col(label).isNull()))
    copies = (
        df.select(*row_fingerprint(features))
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("k"))
        .agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("copies"))
    )
    balance = profile.imbalance(df, label)
    return (
        checks.findings()
        .unionByName(_single(copies, dim, "duplicates", "features", {"copies": True}))
        .unionByName(_single(balance, dim, "class_balance", label, {"ratio": False, "minority_pct": False}))
    )


def validate(accidents: DataFrame, vehicles: DataFrame, merged: DataFrame, date: str = "Date", isolation: bool = True, sample_key: str | None = "Accident_Index") -> DataFrame:
    """All dimensions as one findings table."""
    return reduce(
        DataFrame.unionByName,
        [
            check_accuracy(accidents, vehicles),
            check_consistency(accidents, vehicles, date),
            check_completeness(accidents, vehicles),
            check_uniqueness(merged),
            check_outliers(accidents, vehicles, isolation),
            check_timeliness(accidents, date),
            check_distribution(
                accidents,
                "accidents",
                ["Latitude", "Longitude", "Speed_limit", "Number_of_Casualties", "Number_of_Vehicles"],
                ["Accident_Severity", "Day_of_Week", "Light_Conditions", "Weather_Conditions", "Road_Surface_Conditions", "Urban_or_Rural_Area", "Road_Type"],
                sample_key=sample_key,
            ),
            check_distribution(
                vehicles, "vehicles", ["Age_of_Vehicle"], ["Age_Band_of_Driver", "Sex_of_Driver", "Vehicle_Type", "Vehicle_Manoeuvre"]
            ),
            check_relationships(accidents, ["Speed_limit", "Number_of_Casualties", "Number_of_Vehicles", "Latitude", "Longitude"]),
            check_join_integrity(accidents, vehicles),
            check_weather(merged),
        ],
    )


def _single(one: DataFrame, dimension: str, check: str, subject: str, metrics: Mapping[str, bool]) -> DataFrame:
    """Findings from the columns of a one-row table; the flag tells whether a positive count is an issue."""
    names = list(metrics)
    tall = one.select(*[F.col(m).cast("double").alias(m) for m in names]).unpivot([], names, "metric", "value")
    issue_metrics = [m for m, is_issue in metrics.items() if is_issue]
    return tall.select(
        F.lit(dimension).alias("dimension"),
        F.lit(check).alias("check_name"),
        F.lit(subject).alias("subject"),
        "metric",
        "value",
        F.lit(None).cast("string").alias("detail"),
        (F.col("metric").isin(*issue_metrics) & (F.col("value") > 0) if issue_metrics else F.lit(False)).alias("is_issue"),
    )


def _tall(df: DataFrame, dimension: str, check: str, table: str, metric: Column, value: Column, detail: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(dimension).alias("dimension"),
        F.lit(check).alias("check_name"),
        F.concat(F.lit(table + "."), F.col("column")).alias("subject"),
        metric.alias("metric"),
        value.cast("double").alias("value"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
        F.lit(False).alias("is_issue"),
    )
