"""Profiles, roll-ups, windows, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import presets
from tarmac.catalog.registry import query, unpivot_sql
from tarmac.functions import scalar as fx
from tarmac.operators import balance, clean, correlation, features, impute, order_stats, profile, rollups
from tarmac.sources import domain

_SEVERE = "avg(CASE WHEN Accident_Severity IN ('Fatal', 'Serious') THEN 1e0 ELSE 0e0 END)"
_NUMBERS = ["Speed_limit", "Number_of_Casualties", "Number_of_Vehicles", "Latitude", "Longitude"]


def _nulls_sql(columns):
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows, "
        f"round(count(*) FILTER (WHERE {c} IS NULL) * 100e0 / count(*), 2) AS pct FROM accidents"
        for c in columns
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE nulls > 0"


@query("null_profile", "column:s nulls:i rows:i pct:f", _nulls_sql(domain.ACCIDENT_COLUMNS), ["accidents"])
def null_profile(d):
    return profile.null_profile(d.accidents)


@query("top_missing_columns", "column:s nulls:i pct:f", _nulls_sql(domain.ACCIDENT_COLUMNS) + " ORDER BY nulls DESC, \"column\" LIMIT 12", ["accidents"])
def top_missing_columns(d):
    return profile.top_missing(d.accidents)


@query("columns_over_half_missing", "column:s pct:f", f"SELECT * FROM ({_nulls_sql(domain.ACCIDENT_COLUMNS)}) WHERE pct > 50", ["accidents"])
def columns_over_half_missing(d):
    return profile.over_missing(d.accidents)


STATS_SQL = f"""SELECT "column", min(value) AS min, max(value) AS max, avg(value) AS mean, quantile_cont(value, 0.5) AS median,
    stddev_samp(value) AS std,
    (avg(pow(value - mu, 3))) / pow(stddev_pop(value), 3) AS skewness, avg(pow(value - mu, 4)) / pow(var_pop(value), 2) - 3 AS kurtosis,
    count(*) AS n_valid, count(DISTINCT value) AS cardinality
  FROM (SELECT *, avg(value) OVER (PARTITION BY "column") AS mu FROM {unpivot_sql('accidents', _NUMBERS)} WHERE value IS NOT NULL)
  GROUP BY "column" HAVING count(*) >= 10"""


@query(
    "descriptive_stats",
    "column:s min:f max:f mean:f median:f std:f skewness:f kurtosis:f n_valid:i cardinality:i",
    STATS_SQL,
    ["accidents"],
)
def descriptive_stats(d):
    return profile.descriptive_stats(d.accidents, _NUMBERS)


@query(
    "descriptive_stats_large_state",
    "column:s q1:f median:f q3:f",
    f"""SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
        FROM {unpivot_sql('accidents', _NUMBERS)} WHERE value IS NOT NULL GROUP BY "column\"""",
    ["accidents"],
)
def descriptive_stats_large_state(d):
    # A zero limit takes the running-count path that large columns take.
    found = order_stats.exact_quantiles(d.accidents, _NUMBERS, [0.25, 0.5, 0.75], state_limit=0)
    return d.spark.createDataFrame([(c, *q) for c, q in found.items()], "column string, q1 double, median double, q3 double")


_HIST_COLUMNS = ["Speed_limit", "Number_of_Casualties", "Number_of_Vehicles"]


@query(
    "histogram_equal_width",
    "column:s bin:i bin_start:f bin_end:f n:i pct:f",
    f"""WITH v AS (SELECT * FROM {unpivot_sql('accidents', _HIST_COLUMNS)} WHERE value IS NOT NULL),
      e AS (SELECT "column", min(value) AS lo, max(value) AS hi, count(*) AS nv FROM v GROUP BY "column"),
      b AS (SELECT v."column", least(floor((value - lo) / (hi - lo) * 10), 9) AS bin, count(*) AS n FROM v JOIN e USING ("column") GROUP BY 1, 2),
      s AS (SELECT e.*, unnest(range(10)) AS bin FROM e)
      SELECT s."column", s.bin, lo + (hi - lo) / 10 * s.bin AS bin_start, lo + (hi - lo) / 10 * (s.bin + 1) AS bin_end,
        coalesce(b.n, 0) AS n, coalesce(b.n, 0) * 100e0 / nv AS pct
      FROM s LEFT JOIN b ON s."column" = b."column" AND s.bin = b.bin""",
    ["accidents"],
)
def histogram_equal_width(d):
    return profile.histogram(d.accidents, _HIST_COLUMNS)


@query(
    "value_counts",
    "column:s value:s n:i",
    """SELECT 'Road_Type' AS "column", Road_Type AS value, count(*) AS n FROM accidents WHERE Road_Type IS NOT NULL GROUP BY 2
       UNION ALL SELECT 'Day_of_Week', Day_of_Week, count(*) FROM accidents WHERE Day_of_Week IS NOT NULL GROUP BY 2
       UNION ALL SELECT 'Light_Conditions', Light_Conditions, count(*) FROM accidents WHERE Light_Conditions IS NOT NULL GROUP BY 2""",
    ["accidents"],
)
def value_counts(d):
    return profile.value_counts(d.accidents, ["Road_Type", "Day_of_Week", "Light_Conditions"])


@query(
    "class_distribution",
    "label:s n:i pct:f",
    "SELECT Accident_Severity AS label, count(*) AS n, count(*) * 100e0 / sum(count(*)) OVER () AS pct FROM accidents GROUP BY 1",
    ["accidents"],
)
def class_distribution(d):
    return profile.class_distribution(d.accidents, "Accident_Severity")


@query(
    "imbalance_ratio",
    "classes:i ratio:f minority_pct:f is_balanced:i",
    """SELECT count(*) AS classes, max(n) / CAST(min(n) AS DOUBLE) AS ratio, min(n) * 100e0 / sum(n) AS minority_pct,
         CASE WHEN min(n) * 100e0 / sum(n) >= 5 THEN 1 ELSE 0 END AS is_balanced
       FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)""",
)
def imbalance_ratio(d):
    return profile.imbalance(d.labels, "toxic")


def _fences_sql(table, columns):
    return f"""WITH v AS (SELECT * FROM {unpivot_sql(table, columns)} WHERE value IS NOT NULL),
      q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY "column")
      SELECT v."column", q1, q3, q1 - 1.5e0 * (q3 - q1) AS lower_fence, q3 + 1.5e0 * (q3 - q1) AS upper_fence,
        count(*) FILTER (WHERE value < q1 - 1.5e0 * (q3 - q1) OR value > q3 + 1.5e0 * (q3 - q1)) AS outliers, count(*) AS n_valid
      FROM v JOIN q USING ("column") GROUP BY 1, q1, q3"""


_WEATHER_NUMBERS = ["temp", "prcp", "snwd", "wspd", "tsun"]


@query(
    "iqr_fences",
    "column:s q1:f q3:f lower_fence:f upper_fence:f outliers:i n_valid:i",
    _fences_sql("weather", _WEATHER_NUMBERS),
    ["weather"],
)
def iqr_fences(d):
    return profile.iqr_outliers(d.weather, _WEATHER_NUMBERS)


@query(
    "top_outlier_columns",
    "column:s outliers:i pct_outliers:f",
    f"""SELECT "column", outliers, round(outliers * 100e0 / n_valid, 2) AS pct_outliers FROM ({_fences_sql('accidents', _NUMBERS)})
        WHERE outliers > 0 ORDER BY outliers DESC, "column" LIMIT 3""",
    ["accidents"],
)
def top_outlier_columns(d):
    return profile.top_outliers(d.accidents, _NUMBERS, 3)


def _complete(columns, table="accidents"):
    picked = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"(SELECT {picked} FROM {table} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in columns) + ")"


def _pairs_sql(columns, source, value):
    parts = [
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS {value} FROM {source}"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    return " UNION ALL ".join(parts)


def ranked_sql(columns, source):
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS {c}" for c in columns
    )
    return f"(SELECT {ranks} FROM {source})"


PEARSON_SQL = _pairs_sql(_NUMBERS, _complete(_NUMBERS), "pearson")
SPEARMAN_SQL = _pairs_sql(_NUMBERS, ranked_sql(_NUMBERS, _complete(_NUMBERS)), "spearman")


@query("pearson_matrix", "left:s right:s pearson:f", PEARSON_SQL, ["accidents"])
def pearson_matrix(d):
    return correlation.pearson_pairs(d.accidents, _NUMBERS)


@query("spearman_matrix", "left:s right:s spearman:f", SPEARMAN_SQL, ["accidents"])
def spearman_matrix(d):
    return correlation.spearman_pairs(d.accidents, _NUMBERS)


COMPARE_SQL = f"""SELECT *, round(abs(pearson - spearman), 3) AS diff, CASE WHEN round(abs(pearson - spearman), 3) > 0.1e0 THEN 1 ELSE 0 END AS is_non_linear,
    CASE WHEN abs(pearson) > 0.85e0 OR abs(spearman) > 0.85e0 THEN 1 ELSE 0 END AS is_issue
  FROM (SELECT p."left", p."right", round(pearson, 3) AS pearson, round(spearman, 3) AS spearman
        FROM ({PEARSON_SQL}) AS p JOIN ({SPEARMAN_SQL}) AS s USING ("left", "right"))"""


@query(
    "pearson_vs_spearman",
    "left:s right:s pearson:f spearman:f diff:f is_non_linear:i is_issue:i",
    COMPARE_SQL,
    ["accidents"],
)
def pearson_vs_spearman(d):
    return correlation.compare_correlations(d.accidents, _NUMBERS)


@query(
    "average_ranks",
    "value:f n:i rank:f",
    """SELECT value, count(*) AS n, avg(r) AS rank FROM (SELECT Latitude AS value, row_number() OVER (ORDER BY Latitude) AS r
         FROM accidents WHERE Latitude IS NOT NULL) GROUP BY value""",
    ["accidents"],
)
def average_ranks(d):
    return order_stats.average_ranks(d.accidents, ["Latitude"])


@query("date_span", "earliest:s latest:s", "SELECT min(Date) AS earliest, max(Date) AS latest FROM accidents", ["accidents"])
def date_span(d):
    return profile.date_span(d.accidents, "Date")


@query(
    "vehicles_per_accident",
    "keys:i rows_per_key:f",
    "SELECT count(DISTINCT Accident_Index) AS keys, count(*) / CAST(count(DISTINCT Accident_Index) AS DOUBLE) AS rows_per_key FROM vehicles",
    ["vehicles"],
)
def vehicles_per_accident(d):
    return profile.rows_per_key(d.vehicles, "Accident_Index")


@query(
    "severe_rate_by_speed",
    "Speed_limit:i Accidents:i SevereRate:f",
    f"SELECT Speed_limit, count(*) AS Accidents, {_SEVERE} AS SevereRate FROM accidents WHERE Speed_limit IS NOT NULL GROUP BY 1 HAVING count(*) > 50",
    ["accidents"],
)
def severe_rate_by_speed(d):
    return rollups.severe_rate_by(rollups.severe_flag(d.accidents), "Speed_limit", 50)


_BY_VEHICLE = f"""SELECT Vehicle_Type, count(*) AS Accidents, {_SEVERE} AS SevereRate
  FROM accidents JOIN vehicles USING (Accident_Index) WHERE Vehicle_Type IS NOT NULL GROUP BY Vehicle_Type"""


@query(
    "severe_rate_by_vehicle",
    "Vehicle_Type:s Accidents:i SevereRate:f",
    f"{_BY_VEHICLE} ORDER BY Accidents DESC, Vehicle_Type LIMIT 5",
    ["accidents", "vehicles"],
)
def severe_rate_by_vehicle(d):
    rows = d.accidents.select("Accident_Index", "Accident_Severity").join(d.vehicles.select("Accident_Index", "Vehicle_Type"), "Accident_Index")
    return rollups.top_groups(rollups.severe_flag(rows), "Vehicle_Type", 5)


@query(
    "mean_by_category",
    "Pedestrian_Crossing:s mean:f",
    """SELECT Pedestrian_Crossing, avg(CASE Accident_Severity WHEN 'Slight' THEN 0 WHEN 'Serious' THEN 1 ELSE 2 END) AS mean FROM accidents
       WHERE Accident_Severity IN ('Slight', 'Serious', 'Fatal') AND Pedestrian_Crossing IS NOT NULL GROUP BY 1""",
    ["accidents"],
)
def mean_by_category(d):
    return rollups.mean_by_category(features.encode_target(d.accidents), "Pedestrian_Crossing", "Accident_Severity")


def _decile_sql(column, source, q=10):
    qs = ", ".join(f"{i / q}e0" for i in range(q + 1))
    return f"""WITH v AS (SELECT CAST({column} AS DOUBLE) AS x, Accident_Severity FROM {source} WHERE {column} IS NOT NULL),
      e AS (SELECT list_sort(list_distinct(quantile_cont(x, [{qs}]))) AS edges FROM v)
      SELECT 1 + len(list_filter(list_slice(edges, 2, len(edges) - 1), lambda y: x > y)) AS RiskDecile, count(*) AS Accidents, {_SEVERE} AS SevereRate
      FROM v, e GROUP BY 1"""


@query(
    "severe_rate_by_decile",
    "RiskDecile:i Accidents:i SevereRate:f",
    _decile_sql("Latitude", "accidents"),
    ["accidents"],
)
def severe_rate_by_decile(d):
    return rollups.severe_rate_by_decile(rollups.severe_flag(d.accidents), "Latitude")


@query(
    "quantile_bin_repeated_edges",
    "RiskDecile:i Accidents:i SevereRate:f",
    _decile_sql("Speed_limit", "accidents"),
    ["accidents"],
)
def quantile_bin_repeated_edges(d):
    return rollups.severe_rate_by_decile(rollups.severe_flag(d.accidents), "Speed_limit")


@query(
    "engine_band_by_severity",
    "band:i band_start:f band_end:f Accident_Severity:s Count:i",
    """WITH m AS (SELECT Engine_Capacity_CC AS x, Accident_Severity FROM accidents JOIN vehicles USING (Accident_Index) WHERE Engine_Capacity_CC > 0),
      t AS (SELECT * FROM m WHERE x <= (SELECT quantile_cont(CAST(x AS DOUBLE), 0.99) FROM m)),
      b AS (SELECT CAST(min(x) AS DOUBLE) AS lo, (max(x) - min(x)) / 8e0 AS w FROM t)
      SELECT band, lo + w * band AS band_start, lo + w * (band + 1) AS band_end, Accident_Severity, count(*) AS "Count"
      FROM (SELECT greatest(0, least(7, ceil((x - lo) / w) - 1)) AS band, lo, w, Accident_Severity FROM t, b) GROUP BY band, lo, w, Accident_Severity""",
    ["accidents", "vehicles"],
)
def engine_band_by_severity(d):
    rows = d.accidents.select("Accident_Index", "Accident_Severity").join(d.vehicles.select("Accident_Index", "Engine_Capacity_CC"), "Accident_Index")
    return rollups.engine_band_by_severity(rows)


@query(
    "severity_share",
    "Severity:s Count:i Share:f position:i",
    """SELECT Accident_Severity AS Severity, count(*) AS "Count", count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS Share,
         list_position(['Fatal', 'Serious', 'Slight'], Accident_Severity) AS position
       FROM accidents WHERE Accident_Severity IN ('Fatal', 'Serious', 'Slight') GROUP BY 1""",
    ["accidents"],
)
def severity_share(d):
    return rollups.severity_share(d.accidents)


@query(
    "dashboard_kpis",
    "total:i fatal:i serious:i severe_share:f peak_group:i",
    """SELECT count(*) AS total, count(*) FILTER (WHERE Accident_Severity = 'Fatal') AS fatal,
         count(*) FILTER (WHERE Accident_Severity = 'Serious') AS serious,
         count(*) FILTER (WHERE Accident_Severity IN ('Fatal', 'Serious')) / CAST(count(*) AS DOUBLE) AS severe_share,
         (SELECT Speed_limit FROM accidents WHERE Speed_limit IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, Speed_limit LIMIT 1) AS peak_group
       FROM accidents""",
    ["accidents"],
)
def dashboard_kpis(d):
    return rollups.dashboard_kpis(d.accidents)


def _calendar_sql(where, unit, label):
    return f"""SELECT {label} AS period, count(c.d) AS n FROM
      (SELECT unnest(generate_series(date_trunc('{unit}', min(Date)), date_trunc('{unit}', max(Date)), INTERVAL 1 {unit})) AS s FROM accidents {where}) AS spine
      LEFT JOIN (SELECT date_trunc('{unit}', Date) AS p, Date AS d FROM accidents {where}) AS c ON c.p = spine.s GROUP BY spine.s"""


_MONTHS = _calendar_sql("", "month", "CAST(last_day(spine.s) AS DATE)")
_FATAL_WEEKS = _calendar_sql("WHERE Accident_Severity = 'Fatal'", "week", "CAST(spine.s + INTERVAL 6 DAY AS DATE)")
_DAYS = _calendar_sql("", "day", "CAST(spine.s AS DATE)")
_YEARS = _calendar_sql("", "year", "CAST(spine.s AS DATE)")


@query("monthly_counts", "period:s n:i", _MONTHS, ["accidents"])
def monthly_counts(d):
    return rollups.calendar_counts(d.accidents, "Date", "month")


@query("weekly_fatal", "period:s n:i", _FATAL_WEEKS, ["accidents"])
def weekly_fatal(d):
    return rollups.calendar_counts(d.accidents.where("Accident_Severity = 'Fatal'"), "Date", "week")


@query("daily_counts", "period:s n:i", _DAYS, ["accidents"])
def daily_counts(d):
    return rollups.calendar_counts(d.accidents, "Date", "day")


@query("yearly_counts", "period:s n:i", _YEARS, ["accidents"])
def yearly_counts(d):
    return rollups.calendar_counts(d.accidents, "Date", "year")


@query(
    "weekday_average",
    "weekday:s position:i mean:f",
    f"SELECT dayname(period) AS weekday, isodow(period) - 1 AS position, avg(n) AS mean FROM ({_DAYS}) GROUP BY 1, 2",
    ["accidents"],
)
def weekday_average(d):
    return rollups.weekday_average(d.accidents, "Date")


@query(
    "hour_histogram",
    "hour:i n:i",
    """SELECT h AS hour, count(a.t) AS n FROM (SELECT unnest(range(24)) AS h) AS hours
       LEFT JOIN (SELECT TRY_CAST(substr(Time, 1, 2) AS INT) AS t FROM accidents) AS a ON a.t = h GROUP BY h""",
    ["accidents"],
)
def hour_histogram(d):
    return rollups.hour_histogram(d.accidents, fx.hour_of_time("Time"))


@query(
    "daypart_counts",
    "daypart:s n:i",
    """SELECT CASE WHEN h BETWEEN 5 AND 9 THEN 'morning rush (5-10)' WHEN h BETWEEN 10 AND 14 THEN 'office hours (10-15)'
         WHEN h BETWEEN 15 AND 18 THEN 'afternoon rush (15-19)' WHEN h BETWEEN 19 AND 22 THEN 'evening (19-23)' ELSE 'night (23-5)' END AS daypart,
         count(*) AS n FROM (SELECT TRY_CAST(substr(Time, 1, 2) AS INT) AS h FROM accidents) WHERE h IS NOT NULL GROUP BY 1""",
    ["accidents"],
)
def daypart_counts(d):
    return rollups.daypart_counts(d.accidents, fx.hour_of_time("Time"))


@query(
    "event_counts_by_day",
    "period:s n:i",
    """SELECT CAST(s AS DATE) AS period, count(e.ts) AS n FROM
       (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 day)) AS s FROM events) AS spine
       LEFT JOIN events AS e ON date_trunc('day', e.ts) = s GROUP BY s""",
)
def event_counts_by_day(d):
    return rollups.calendar_counts(d.events, "ts", "day")


@query(
    "mean_and_mode",
    "column:s value:s n:i",
    """SELECT * FROM (SELECT 'Road_Type' AS "column", Road_Type AS value, count(*) AS n FROM accidents WHERE Road_Type IS NOT NULL GROUP BY 2
         ORDER BY n DESC, value LIMIT 1)
       UNION ALL SELECT * FROM (SELECT 'Time', Time, count(*) AS n FROM accidents WHERE Time IS NOT NULL GROUP BY 2 ORDER BY n DESC, Time LIMIT 1)
       UNION ALL SELECT 'mean_speed', CAST(CAST(floor(avg(Speed_limit)) AS BIGINT) AS VARCHAR), count(Speed_limit) FROM accidents""",
    ["accidents"],
)
def mean_and_mode(d):
    mean = d.accidents.agg(
        F.lit("mean_speed").alias("column"),
        F.floor(F.avg("Speed_limit")).cast("string").alias("value"),
        F.count("Speed_limit").alias("n"),
    )
    return order_stats.modes(d.accidents, ["Road_Type", "Time"]).unionByName(mean)


@query(
    "driver_age_extremes",
    "Accident_Index:i Vehicle_Reference:i Age_of_Driver:f max_driver_age:f min_driver_age:f num_motorcycles:i avg_vehicle_age:f",
    """SELECT Accident_Index, Vehicle_Reference, Age_of_Driver, max(Age_of_Driver) OVER w AS max_driver_age, min(Age_of_Driver) OVER w AS min_driver_age,
         sum(CASE WHEN contains(coalesce(Vehicle_Type, ''), 'Motorcycle') THEN 1 ELSE 0 END) OVER w AS num_motorcycles,
         avg(Age_of_Vehicle) OVER w AS avg_vehicle_age FROM vehicles WINDOW w AS (PARTITION BY Accident_Index)""",
    ["vehicles"],
)
def driver_age_extremes(d):
    return features.vehicle_features(d.vehicles)


@query(
    "driver_age_extremes_salted",
    "Accident_Index:i Vehicle_Reference:i max_driver_age:f min_driver_age:f",
    """SELECT Accident_Index, Vehicle_Reference, max(Age_of_Driver) OVER w AS max_driver_age, min(Age_of_Driver) OVER w AS min_driver_age
       FROM vehicles WINDOW w AS (PARTITION BY Accident_Index)""",
    ["vehicles"],
)
def driver_age_extremes_salted(d):
    return features.vehicle_features(d.vehicles, rows_per_salt=2, small_bytes=0)


@query(
    "monthly_rolling_mean",
    "period:s n:i rolling_mean:f",
    f"""SELECT period, n, CASE WHEN count(*) OVER w = 10 THEN avg(n) OVER w END AS rolling_mean FROM ({_MONTHS})
        WINDOW w AS (ORDER BY period ROWS 9 PRECEDING)""",
    ["accidents"],
)
def monthly_rolling_mean(d):
    return rollups.rolling_mean(rollups.calendar_counts(d.accidents, "Date", "month"))


@query(
    "weekly_fatal_rolling_mean",
    "period:s n:i rolling_mean:f",
    f"""SELECT period, n, CASE WHEN count(*) OVER w = 10 THEN avg(n) OVER w END AS rolling_mean FROM ({_FATAL_WEEKS})
        WINDOW w AS (ORDER BY period ROWS 9 PRECEDING)""",
    ["accidents"],
)
def weekly_fatal_rolling_mean(d):
    return rollups.rolling_mean(rollups.calendar_counts(d.accidents.where("Accident_Severity = 'Fatal'"), "Date", "week"))


@query(
    "flag_duplicates",
    "full_duplicates:i composite_duplicates:i key_repeats:i",
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) AS full_duplicates,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT Accident_Index, Vehicle_Reference FROM v)) AS composite_duplicates,
         count(*) - count(DISTINCT Accident_Index) AS key_repeats
       FROM vehicles AS v""".replace(" FROM v)", " FROM vehicles)"),
    ["vehicles"],
)
def flag_duplicates(d):
    return profile.duplicate_counts(d.vehicles, ["Accident_Index", "Vehicle_Reference"], "Accident_Index")


@query(
    "duplicate_rows",
    "Accident_Index:i Vehicle_Reference:i Year:i",
    f"""SELECT Accident_Index, Vehicle_Reference, Year FROM (SELECT *, count(*) OVER (PARTITION BY {', '.join(domain.VEHICLE_COLUMNS)}) AS n
       FROM (SELECT * FROM vehicles UNION ALL SELECT * FROM vehicles WHERE Vehicle_Reference = 2)) WHERE n > 1""",
    ["vehicles"],
)
def duplicate_rows(d):
    # The table has no copies of its own: its second vehicles are added once more.
    return profile.duplicate_rows(d.vehicles.unionByName(d.vehicles.where("Vehicle_Reference = 2")))


@query(
    "dedupe_first",
    "Accident_Index:i Vehicle_Reference:i Year:i",
    """SELECT Accident_Index, Vehicle_Reference, Year FROM (SELECT *, row_number() OVER (PARTITION BY Accident_Index ORDER BY Vehicle_Reference, Year) AS rn
       FROM vehicles) WHERE rn = 1""",
    ["vehicles"],
)
def dedupe_first(d):
    return clean.first_per_key(d.vehicles.select("Accident_Index", "Vehicle_Reference", "Year"), ["Accident_Index"], ["Vehicle_Reference"])


@query(
    "fill_forward_back",
    "Accident_Index:i Speed_limit:i Road_Type:s",
    """SELECT Accident_Index,
         coalesce(last_value(Speed_limit IGNORE NULLS) OVER f, first_value(Speed_limit IGNORE NULLS) OVER b) AS Speed_limit,
         coalesce(last_value(Road_Type IGNORE NULLS) OVER f, first_value(Road_Type IGNORE NULLS) OVER b) AS Road_Type
       FROM accidents WINDOW f AS (ORDER BY Accident_Index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (ORDER BY Accident_Index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    ["accidents"],
)
def fill_forward_back(d):
    rows = d.accidents.select("Accident_Index", "Speed_limit", "Road_Type")
    return impute.fill_forward_back(rows, ["Speed_limit", "Road_Type"], "Accident_Index")


@query(
    "fixed_size_sample",
    "event_id:i value:f",
    """SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || CAST(event_id AS STRING)), 1, 15) AS BIGINT)) AS rn
       FROM events) WHERE rn <= 500""",
)
def fixed_size_sample(d):
    return balance.fixed_size_sample(d.events, "event_id", 500)


@query(
    "peak_group",
    "best:i n:i",
    "SELECT Speed_limit AS best, count(*) AS n FROM accidents WHERE Speed_limit IS NOT NULL GROUP BY 1 ORDER BY n DESC, best LIMIT 1",
    ["accidents"],
)
def peak_group(d):
    counts = d.accidents.where("Speed_limit IS NOT NULL").groupBy("Speed_limit").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("Speed_limit", F.struct("n", (-F.col("Speed_limit")).alias("t"))).alias("best"), F.max("n").alias("n"))


@query(
    "custom_category_order",
    "weekday:s position:i n:i",
    """SELECT Day_of_Week AS weekday, list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], Day_of_Week) AS position,
         count(*) AS n FROM accidents WHERE Day_of_Week IS NOT NULL AND Day_of_Week <> 'Someday' GROUP BY 1, 2""",
    ["accidents"],
)
def custom_category_order(d):
    counts = d.accidents.where(fx.is_member("Day_of_Week", presets.WEEKDAYS)).groupBy(F.col("Day_of_Week").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("position", rollups.in_order(F.col("weekday"), presets.WEEKDAYS)).orderBy("position")
