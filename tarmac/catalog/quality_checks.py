"""Data-quality checks as findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import presets
from tarmac.catalog.aggregates import COMPARE_SQL
from tarmac.catalog.integration import gb_stations
from tarmac.catalog.registry import query, unpivot_sql
from tarmac.operators import balance, clean, impute, joins, normality, profile, quality
from tarmac.session import new_path
from tarmac.sources import domain, snapshots

_FINDING = "dimension:s check_name:s subject:s metric:s value:f detail:s is_issue:i"
_DAYS = "('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday')"


def _finding(dimension, check, subject, metric, value, table, issue="value > 0", detail="NULL"):
    return (
        f"SELECT '{dimension}' AS dimension, '{check}' AS check_name, '{subject}' AS subject, '{metric}' AS metric, value, {detail} AS detail, "
        f"{issue} AS is_issue FROM (SELECT CAST({value} AS DOUBLE) AS value FROM {table})"
    )


def _bad(condition):
    return f"count(*) FILTER (WHERE {condition})"


ACCURACY_SQL = " UNION ALL ".join(
    [
        _finding("accuracy", "severity_domain", "Accident_Severity", "invalid", _bad("Accident_Severity IS NULL OR Accident_Severity NOT IN ('Slight', 'Serious', 'Fatal', '1', '2', '3')"), "accidents"),
        _finding("accuracy", "speed_domain", "Speed_limit", "invalid", _bad("Speed_limit NOT IN (20, 30, 40, 50, 60, 70)"), "accidents"),
        _finding("accuracy", "coordinate_bounds", "Latitude", "out_of_bounds", _bad("Latitude < 49 OR Latitude > 61"), "accidents"),
        _finding("accuracy", "coordinate_bounds", "Longitude", "out_of_bounds", _bad("Longitude < -8 OR Longitude > 2"), "accidents"),
        _finding("accuracy", "vehicle_count", "Number_of_Vehicles", "non_positive", _bad("Number_of_Vehicles <= 0"), "accidents"),
        _finding("accuracy", "weekday_domain", "Day_of_Week", "invalid", _bad(f"Day_of_Week IS NULL OR Day_of_Week NOT IN {_DAYS}"), "accidents"),
        _finding("accuracy", "vehicle_age", "Age_of_Vehicle", "negative", _bad("Age_of_Vehicle < 0"), "vehicles"),
        _finding("accuracy", "sex_domain", "Sex_of_Driver", "invalid", _bad("Sex_of_Driver IS NULL OR lower(trim(Sex_of_Driver)) NOT IN ('male', 'female')"), "vehicles"),
        _finding("accuracy", "age_bands", "Age_Band_of_Driver", "distinct", "count(DISTINCT Age_Band_of_Driver)", "vehicles", "false"),
    ]
)


@query("check_accuracy", _FINDING, ACCURACY_SQL, ["accidents", "vehicles"])
def check_accuracy(d):
    return quality.check_accuracy(d.accidents, d.vehicles)


@query(
    "age_band_sample",
    "Age_Band_of_Driver:s",
    "SELECT DISTINCT Age_Band_of_Driver FROM vehicles WHERE Age_Band_of_Driver IS NOT NULL ORDER BY 1 LIMIT 10",
    ["vehicles"],
)
def age_band_sample(d):
    return quality.age_band_sample(d.vehicles)


_PARSED = "(SELECT *, TRY_CAST(Date_Text AS DATE) AS p FROM accidents)"
_FIRST_VEHICLE = """(SELECT Accident_Index, Year FROM (SELECT *, row_number() OVER (PARTITION BY Accident_Index ORDER BY Vehicle_Reference, Year) AS rn
  FROM vehicles) WHERE rn = 1)"""
CONSISTENCY_SQL = " UNION ALL ".join(
    [
        _finding("consistency", "date_parses", "Date_Text", "failures", _bad("p IS NULL AND Date_Text IS NOT NULL"), _PARSED),
        _finding("consistency", "year_matches_date", "Year", "mismatches", _bad("NOT coalesce(year(p) = Year, false)"), _PARSED),
        _finding("consistency", "weekday_matches_date", "Day_of_Week", "mismatches", _bad("NOT coalesce(dayname(p) = Day_of_Week, false)"), _PARSED, "false", "'WARN'"),
        _finding("consistency", "time_format", "Time", "malformed", _bad(r"NOT regexp_matches(Time, '^\d{1,2}:\d{2}$')"), "accidents"),
        _finding("consistency", "year_across_tables", "Year", "mismatches", _bad("NOT coalesce(a.Year = v.Year, false)"), f"accidents AS a JOIN {_FIRST_VEHICLE} AS v USING (Accident_Index)"),
    ]
)


@query("check_consistency", _FINDING, CONSISTENCY_SQL, ["accidents", "vehicles"])
def check_consistency(d):
    return quality.check_consistency(d.accidents, d.vehicles, "Date_Text")




def _missing_sql(table, columns):
    parts = []
    for c in columns:
        required = c in presets.CRITICAL_COLUMNS
        detail = "'REQUIRED'" if required else "CASE WHEN value > 50 THEN 'ADVICE drop' END"
        parts.append(
            f"SELECT * FROM (SELECT 'completeness' AS dimension, 'missing' AS check_name, '{table}.{c}' AS subject, 'pct_null' AS metric, value, {detail} AS detail, "
            f"{str(required).lower()} AS is_issue FROM (SELECT round(count(*) FILTER (WHERE {c} IS NULL) * 100e0 / count(*), 2) AS value, count(*) FILTER (WHERE {c} IS NULL) AS n FROM {table}) WHERE n > 0)"
        )
    return " UNION ALL ".join(parts)


@query(
    "check_completeness",
    _FINDING,
    _missing_sql("accidents", domain.ACCIDENT_COLUMNS) + " UNION ALL " + _missing_sql("vehicles", domain.VEHICLE_COLUMNS),
    ["accidents", "vehicles"],
)
def check_completeness(d):
    return quality.check_completeness(d.accidents, d.vehicles)


_PAIRS = f"(SELECT a.*, {', '.join('v.' + c + ' AS v_' + c for c in domain.VEHICLE_COLUMNS if c not in ('Accident_Index', 'Vehicle_Reference'))}, Vehicle_Reference FROM accidents AS a LEFT JOIN vehicles AS v USING (Accident_Index))"


@query(
    "check_uniqueness",
    _FINDING,
    " UNION ALL ".join(
        [
            _finding("uniqueness", "duplicates", "merged", "full_duplicates", f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_PAIRS}))", _PAIRS),
            _finding("uniqueness", "duplicates", "merged", "composite_duplicates", f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT Accident_Index, Vehicle_Reference FROM {_PAIRS}))", _PAIRS),
            _finding("uniqueness", "duplicates", "merged", "key_repeats", "count(*) - count(DISTINCT Accident_Index)", _PAIRS, "false"),
        ]
    ),
    ["accidents", "vehicles"],
)
def check_uniqueness(d):
    merged = joins.merge_details(d.accidents, d.vehicles)
    return quality.check_uniqueness(merged)


def _iqr_findings(table, columns):
    fences = f"""(WITH v AS (SELECT * FROM {unpivot_sql(table, columns)} WHERE value IS NOT NULL),
      q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY "column")
      SELECT v."column", q1 - 1.5e0 * (q3 - q1) AS lower_fence, q3 + 1.5e0 * (q3 - q1) AS upper_fence,
        CAST(count(*) FILTER (WHERE value < q1 - 1.5e0 * (q3 - q1) OR value > q3 + 1.5e0 * (q3 - q1)) AS DOUBLE) AS iqr_outliers
      FROM v JOIN q USING ("column") GROUP BY 1, q1, q3)"""
    return " UNION ALL ".join(
        f"SELECT 'outliers' AS dimension, 'iqr' AS check_name, '{table}.' || \"column\" AS subject, '{m}' AS metric, round({m}, 2) AS value, NULL AS detail, false AS is_issue FROM {fences}"
        for m in ("iqr_outliers", "lower_fence", "upper_fence")
    )


@query(
    "check_outliers_iqr",
    _FINDING,
    _iqr_findings("accidents", ["Speed_limit", "Number_of_Casualties", "Number_of_Vehicles"]) + " UNION ALL " + _iqr_findings("vehicles", ["Age_of_Vehicle", "Engine_Capacity_CC"]),
    ["accidents", "vehicles"],
)
def check_outliers_iqr(d):
    return quality.check_outliers(d.accidents, d.vehicles, isolation=False)


@query("check_outliers_isolation", _FINDING)
def check_outliers_isolation(d):
    return quality.check_outliers(d.accidents, d.vehicles).where("check_name = 'isolation_forest'")


@query(
    "check_timeliness",
    _FINDING,
    " UNION ALL ".join(
        [
            _finding("timeliness", "date_span", "Date_Text", "earliest_day", "min(p) - DATE '1970-01-01'", _PARSED, "false"),
            _finding("timeliness", "date_span", "Date_Text", "latest_day", "max(p) - DATE '1970-01-01'", _PARSED, "false"),
            _finding("timeliness", "future_dates", "Date_Text", "rows", _bad("p > DATE '2000-06-30'"), _PARSED),
            _finding("timeliness", "early_dates", "Date_Text", "rows", _bad("p < DATE '2005-01-01'"), _PARSED),
        ]
    ),
    ["accidents"],
)
def check_timeliness(d):
    return quality.check_timeliness(d.accidents, "Date_Text", today="2000-06-30")


_DIST = ["Speed_limit", "Number_of_Casualties"]
_STATS = "min max mean median std skewness kurtosis n_valid cardinality".split()
def _profile_sql(dimension, table, columns):
    values = f"(SELECT * FROM {unpivot_sql(table, columns)} WHERE value IS NOT NULL)"
    return f"""SELECT '{dimension}' AS dimension, 'descriptive_stats' AS check_name, '{table}.' || "column" AS subject, metric, value, NULL AS detail, false AS is_issue
  FROM (UNPIVOT (SELECT "column", {', '.join(f'round(CAST({m} AS DOUBLE), 3) AS {m}' for m in _STATS)} FROM (
    SELECT "column", min(value) AS min, max(value) AS max, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std,
      avg(pow(value - mu, 3)) / pow(stddev_pop(value), 3) AS skewness, avg(pow(value - mu, 4)) / pow(var_pop(value), 2) - 3 AS kurtosis,
      count(*) AS n_valid, count(DISTINCT value) AS cardinality
    FROM (SELECT *, avg(value) OVER (PARTITION BY "column") AS mu FROM {values}) GROUP BY "column" HAVING count(*) >= 10))
    ON {', '.join(_STATS)} INTO NAME metric VALUE value)
  UNION ALL SELECT '{dimension}', 'histogram', '{table}.' || "column", 'bin_' || CAST(bin AS VARCHAR), n, NULL, false FROM (
    WITH v AS {values},
      e AS (SELECT "column", min(value) AS lo, max(value) AS hi FROM v GROUP BY "column"),
      b AS (SELECT v."column", CAST(least(floor((value - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM v JOIN e USING ("column") GROUP BY 1, 2),
      s AS (SELECT e."column", unnest(range(10)) AS bin FROM e)
    SELECT s."column", s.bin, coalesce(b.n, 0) AS n FROM s LEFT JOIN b ON s."column" = b."column" AND s.bin = b.bin)
  UNION ALL {_ks_findings_sql(dimension, 'ks_normal', table, columns)}"""


# The error function by Abramowitz and Stegun 7.1.26 is good to 1.5e-7: enough for 4 decimals of a distance.
_Z = "((x - mu) / (sd * sqrt(2e0)))"
_T = f"(1 / (1 + 0.3275911e0 * abs({_Z})))"
_ERF = f"""(sign({_Z}) * (1 - (((((1.061405429e0 * {_T} - 1.453152027e0) * {_T}) + 1.421413741e0) * {_T} - 0.284496736e0) * {_T} + 0.254829592e0) * {_T} * exp(-({_Z}) * ({_Z}))))"""


def _ks_sql(column, table="accidents"):
    return f"""SELECT '{column}' AS "column", max(greatest(abs(upto / nt - cdf), abs(cdf - (upto - n) / nt))) AS statistic, max(nt) AS n FROM (
      SELECT n, nt, CAST(sum(n) OVER (ORDER BY x) AS DOUBLE) AS upto, 0.5e0 * (1 + {_ERF}) AS cdf FROM (
        SELECT x, n, (SELECT avg(CAST({column} AS DOUBLE)) FROM {table}) AS mu, (SELECT stddev_samp(CAST({column} AS DOUBLE)) FROM {table}) AS sd,
          CAST((SELECT count({column}) FROM {table}) AS DOUBLE) AS nt
        FROM (SELECT CAST({column} AS DOUBLE) AS x, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)))"""


# Kolmogorov's distribution with Stephens' correction, as a series.
_KS_T = "((sqrt(n) + 0.12e0 + 0.11e0 / sqrt(n)) * statistic)"
_KS_P = f"CASE WHEN {_KS_T} < 0.2 THEN 1e0 ELSE greatest(0e0, least(1e0, list_sum([(CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END) * exp(-2e0 * k * k * {_KS_T} * {_KS_T}) FOR k IN range(1, 31)]))) END"


def _ks_findings_sql(dimension, check, table, columns, over=None):
    found = " UNION ALL ".join(_ks_sql(c, over or table) for c in columns)
    return f"""SELECT '{dimension}' AS dimension, '{check}' AS check_name, '{table}.' || "column" AS subject, metric, value, reading AS detail, false AS is_issue FROM (
      UNPIVOT (SELECT "column", CASE WHEN p >= 0.05 THEN 'normal' ELSE 'not normal' END AS reading, round(statistic, 3) AS statistic, round(p, 3) AS p_value
        FROM (SELECT *, {_KS_P} AS p FROM ({found}) WHERE n >= 10)) ON statistic, p_value INTO NAME metric VALUE value)"""


def _sampled_sql(table, column, key):
    return f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL ORDER BY CAST('0x' || substr(md5('42:' || CAST({key} AS STRING)), 1, 15) AS BIGINT) LIMIT 5000)"


_DIST_SQL = f"""{_profile_sql('distribution', 'accidents', _DIST)}
  UNION ALL SELECT 'distribution', 'value_counts', 'accidents.Road_Type', Road_Type, count(*), NULL, false FROM accidents WHERE Road_Type IS NOT NULL GROUP BY Road_Type
  UNION ALL """ + " UNION ALL ".join(
    _ks_findings_sql("distribution", "ks_normal_sampled", "accidents", [c], _sampled_sql("accidents", c, "Accident_Index")) for c in _DIST
)


@query("check_distribution", _FINDING, _DIST_SQL, ["accidents"])
def check_distribution(d):
    return quality.check_distribution(d.accidents, "accidents", _DIST, ["Road_Type"], sample_key="Accident_Index")


@query(
    "ks_normal",
    "column:s n:i statistic:f",
    "SELECT \"column\", n, round(statistic, 4) AS statistic FROM (" + " UNION ALL ".join(_ks_sql(c) for c in ("Latitude", "Longitude", "Speed_limit")) + ")",
    ["accidents"],
)
def ks_normal(d):
    found = normality.ks_normal(d.accidents, ["Latitude", "Longitude", "Speed_limit"])
    return found.select("column", "n", F.round("statistic", 4).alias("statistic"))


@query(
    "ks_normal_sampled",
    "column:s n:i statistic:f p_value:f is_normal:i",
    f"""SELECT "column", n, round(statistic, 4) AS statistic, round(p, 3) AS p_value, CASE WHEN p >= 0.05 THEN 1 ELSE 0 END AS is_normal
        FROM (SELECT *, {_KS_P} AS p FROM ({_ks_sql('value', _sampled_sql('events', 'value', 'event_id'))}))""",
)
def ks_normal_sampled(d):
    found = normality.ks_normal_sampled(d.events, "value", "event_id")
    return found.withColumns({"statistic": F.round("statistic", 4), "p_value": F.round("p_value", 3)})


@query(
    "check_relationships",
    _FINDING,
    f"""SELECT 'relationships' AS dimension, 'correlation' AS check_name, "left" || ' x ' || "right" AS subject, metric, value,
          CASE WHEN is_non_linear = 1 THEN 'non-linear' END AS detail, is_issue = 1 AND metric = 'pearson' AS is_issue
        FROM (UNPIVOT ({COMPARE_SQL}) ON pearson, spearman, diff INTO NAME metric VALUE value)""",
    ["accidents"],
)
def check_relationships(d):
    return quality.check_relationships(d.accidents, ["Speed_limit", "Number_of_Casualties", "Number_of_Vehicles", "Latitude", "Longitude"])


_KEYSETS = """(SELECT count(*) FILTER (WHERE l = 1) AS left_keys, count(*) FILTER (WHERE r = 1) AS right_keys, count(*) FILTER (WHERE l = 1 AND r = 1) AS matched_keys,
  count(*) FILTER (WHERE l = 1 AND r = 0) AS only_left, count(*) FILTER (WHERE l = 0 AND r = 1) AS only_right FROM (
  SELECT k, max(l) AS l, max(r) AS r FROM (SELECT Accident_Index AS k, 1 AS l, 0 AS r FROM accidents UNION ALL SELECT Accident_Index, 0, 1 FROM vehicles) GROUP BY k))"""


@query(
    "check_join_integrity",
    _FINDING,
    " UNION ALL ".join(
        [_finding("join_integrity", "keys", "Accident_Index", m, m, _KEYSETS, "false") for m in ("left_keys", "right_keys", "matched_keys")]
        + [_finding("join_integrity", "keys", "Accident_Index", m, m, _KEYSETS) for m in ("only_left", "only_right")]
        + [
            _finding("join_integrity", "keys", "Accident_Index", "only_left_pct", "only_left * 100e0 / left_keys", _KEYSETS, "false"),
            _finding("join_integrity", "keys", "Accident_Index", "only_right_pct", "only_right * 100e0 / right_keys", _KEYSETS, "false"),
        ]
    ),
    ["accidents", "vehicles"],
)
def check_join_integrity(d):
    return quality.check_join_integrity(d.accidents, d.vehicles)


def _weather_sql():
    parts = []
    for c in presets.WEATHER_COLUMNS:
        low, high = presets.WEATHER_BOUNDS[c]
        parts.append(_finding("weather_distribution", "weather_missing", c, "pct_null", f"round(count(*) FILTER (WHERE {c} IS NULL) * 100e0 / count(*), 2)", "weather", "false"))
        parts.append(_finding("weather_distribution", "weather_missing", c, "over_limit", f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) * 100e0 / count(*) > 20 THEN 1 ELSE 0 END", "weather"))
        parts.append(_finding("weather_distribution", "physical_bounds", c, "out_of_bounds", _bad(f"{c} < {low} OR {c} > {high}"), "weather"))
    return " UNION ALL ".join([*parts, _profile_sql("weather_distribution", "weather", presets.WEATHER_COLUMNS)])


@query("check_weather", _FINDING, _weather_sql(), ["weather"])
def check_weather(d):
    return quality.check_weather(d.weather)


_ACC = domain.ACCIDENT_COLUMNS
_SCORE_SQL = f"""WITH t AS (SELECT {', '.join(_ACC)} FROM accidents),
  parts AS (SELECT ({' + '.join(f'(SELECT CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END FROM t)' for c in _ACC)}) AS nulls,
    (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM t WHERE Latitude < 49 OR Latitude > 61)
    + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM t WHERE Longitude < -11 OR Longitude > 2)
    + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM t WHERE Speed_limit NOT IN (20, 30, 40, 50, 60, 70))
    + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM t WHERE Accident_Severity IS NULL OR Accident_Severity NOT IN ('Fatal', 'Serious', 'Slight'))
    + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM t WHERE Number_of_Casualties > 50) AS broken,
    (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS copies, (SELECT count(*) FROM t) AS n)
  SELECT n AS total_records, {len(_ACC)} AS total_columns, nulls + broken + copies AS issues_found, greatest(0e0, 1 - (nulls + broken + copies) / CAST(n + {len(_ACC)} AS DOUBLE)) AS validation_score FROM parts"""


@query("validation_score", "total_records:i total_columns:i issues_found:i validation_score:f", _SCORE_SQL, ["accidents"])
def validation_score(d):
    return quality.validation_score(d.accidents)


@query(
    "issues_per_dimension",
    "dimension:s findings:i issues:i",
    f"SELECT dimension, count(*) AS findings, count(*) FILTER (WHERE is_issue) AS issues FROM ({ACCURACY_SQL} UNION ALL {CONSISTENCY_SQL}) GROUP BY dimension",
    ["accidents", "vehicles"],
)
def issues_per_dimension(d):
    found = quality.check_accuracy(d.accidents, d.vehicles).unionByName(quality.check_consistency(d.accidents, d.vehicles, "Date_Text"))
    return quality.issues_per_dimension(found)


@query(
    "post_split_checks",
    "check_name:s subject:s metric:s value:f",
    """WITH m AS (SELECT avg(Speed_limit) AS ms, stddev_pop(Speed_limit) AS ss, avg(Number_of_Casualties) AS mc, stddev_pop(Number_of_Casualties) AS sc FROM accidents WHERE Speed_limit IS NOT NULL),
       z AS (SELECT (Speed_limit - ms) / ss AS a, (Number_of_Casualties - mc) / sc AS b, Accident_Severity AS l FROM accidents, m WHERE Speed_limit IS NOT NULL),
       c AS (SELECT l, count(*) AS n FROM z GROUP BY l)
       SELECT 'z_score' AS check_name, 'Speed_limit' AS subject, 'out_of_bounds' AS metric, count(*) FILTER (WHERE abs(a) > 3.5) AS value FROM z
       UNION ALL SELECT 'z_score', 'Number_of_Casualties', 'out_of_bounds', count(*) FILTER (WHERE abs(b) > 3.5) FROM z
       UNION ALL SELECT 'nulls', 'Speed_limit', 'rows', count(*) FILTER (WHERE a IS NULL) FROM z
       UNION ALL SELECT 'nulls', 'Number_of_Casualties', 'rows', count(*) FILTER (WHERE b IS NULL) FROM z
       UNION ALL SELECT 'label', 'Accident_Severity', 'nulls', count(*) FILTER (WHERE l IS NULL) FROM z
       UNION ALL SELECT 'duplicates', 'features', 'copies', count(*) - (SELECT count(*) FROM (SELECT DISTINCT a, b FROM z)) FROM z
       UNION ALL SELECT 'class_balance', 'Accident_Severity', 'ratio', max(n) / CAST(min(n) AS DOUBLE) FROM c
       UNION ALL SELECT 'class_balance', 'Accident_Severity', 'minority_pct', min(n) * 100e0 / sum(n) FROM c""",
    ["accidents"],
)
def post_split_checks(d):
    rows = d.accidents.where("Speed_limit IS NOT NULL").select("Speed_limit", "Number_of_Casualties", "Accident_Severity")
    columns = ["Speed_limit", "Number_of_Casualties"]
    scaled = impute.Scaler.fit(rows, columns).transform(rows)
    return quality.check_split(scaled, columns, "Accident_Severity")


@query("full_validation", _FINDING)
def full_validation(d):
    merged = joins.integrate(d.accidents, d.vehicles, gb_stations(d), d.weather)
    merged = snapshots.write_snapshot(merged, new_path(d.spark, "merged"))
    return quality.validate(d.accidents, d.vehicles, merged)


@query(
    "validate_clean_split_flow",
    "split:s label:s n:i",
    """SELECT CASE WHEN rn <= floor(n * 0.2e0 + 0.5e0) THEN 'test' WHEN rn <= floor(n * (0.2e0 + 0.4e0) + 0.5e0) THEN 'val' ELSE 'train' END AS split, label, count(*) AS n FROM (
         SELECT label, row_number() OVER (PARTITION BY label ORDER BY h) AS rn, count(*) OVER (PARTITION BY label) AS n FROM (
           SELECT Accident_Severity AS label, CAST('0x' || substr(md5('42:' || CAST(Accident_Index AS STRING)), 1, 15) AS BIGINT) AS h FROM accidents
           WHERE Speed_limit IN (20, 30, 40, 50, 60, 70) AND Latitude IS NOT NULL AND Longitude IS NOT NULL)) GROUP BY 1, 2""",
    ["accidents"],
)
def validate_clean_split_flow(d):
    cleaned = clean.clean(d.accidents)
    split = balance.train_val_test(cleaned, "Accident_Severity", "Accident_Index")
    return split.groupBy("split", F.col("Accident_Severity").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "class_balance_gate",
    "label:s pct:f enough:i",
    """SELECT Accident_Severity AS label, count(*) * 100e0 / sum(count(*)) OVER () AS pct, CASE WHEN count(*) * 100e0 / sum(count(*)) OVER () >= 5 THEN 1 ELSE 0 END AS enough
       FROM accidents GROUP BY Accident_Severity""",
    ["accidents"],
)
def class_balance_gate(d):
    return profile.class_distribution(d.accidents, "Accident_Severity").withColumn("enough", (F.col("pct") >= 5).cast("int"))


_GENERIC = [
    ("range", "Latitude", "Latitude < 49 OR Latitude > 61"),
    ("range", "Longitude", "Longitude < -11 OR Longitude > 2"),
    ("range", "Speed_limit", "Speed_limit NOT IN (20, 30, 40, 50, 60, 70)"),
    ("business_rule", "Accident_Severity", "Accident_Severity IS NULL OR Accident_Severity NOT IN ('Fatal', 'Serious', 'Slight')"),
    ("business_rule", "Number_of_Casualties", "Number_of_Casualties > 50"),
]


@query(
    "generic_checks",
    _FINDING,
    " UNION ALL ".join(_finding("generic", check, subject, "violations", _bad(rule), "accidents") for check, subject, rule in _GENERIC),
    ["accidents"],
)
def generic_checks(d):
    return quality.generic_checks(d.accidents)


@query(
    "column_presence_guard",
    "check_name:s subject:s metric:s value:f detail:s",
    f"""SELECT 'severity_domain' AS check_name, 'Accident_Severity' AS subject, 'invalid' AS metric,
          {_bad("Accident_Severity NOT IN ('Slight', 'Serious', 'Fatal', '1', '2', '3')")} AS value, NULL AS detail FROM accidents
        UNION ALL SELECT * FROM (VALUES ('speed_domain', 'Speed_limit', 'skipped', NULL, 'SKIP missing Speed_limit'),
          ('coordinate_bounds', 'Latitude,Longitude', 'skipped', NULL, 'SKIP missing Latitude,Longitude'),
          ('vehicle_count', 'Number_of_Vehicles', 'skipped', NULL, 'SKIP missing Number_of_Vehicles'),
          ('weekday_domain', 'Day_of_Week', 'skipped', NULL, 'SKIP missing Day_of_Week'),
          ('vehicle_age', 'Age_of_Vehicle', 'skipped', NULL, 'SKIP missing Age_of_Vehicle'),
          ('sex_domain', 'Sex_of_Driver', 'skipped', NULL, 'SKIP missing Sex_of_Driver'),
          ('age_bands', 'Age_Band_of_Driver', 'skipped', NULL, 'SKIP missing Age_Band_of_Driver'))""",
    ["accidents"],
)
def column_presence_guard(d):
    return quality.check_accuracy(d.accidents.select("Accident_Index", "Accident_Severity"), d.vehicles.select("Accident_Index"))


@query(
    "missing_columns",
    "column:s rows:i",
    "SELECT c AS \"column\", (SELECT count(*) FROM weather) AS rows FROM (SELECT unnest(['dewpoint', 'visibility']) AS c)",
    ["weather"],
)
def missing_columns(d):
    absent = quality.missing_columns(d.weather, [*presets.WEATHER_COLUMNS, "visibility", "dewpoint"])
    return d.weather.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*[F.lit(c) for c in absent])).alias("column"), "rows")


@query(
    "column_types",
    "column:s dtype:s rows:i",
    """SELECT c AS "column", t AS dtype, (SELECT count(*) FROM events) AS rows FROM (VALUES ('event_id', 'bigint'), ('user_id', 'bigint'), ('event_type', 'string'),
       ('value', 'double'), ('props', 'string')) AS v(c, t)""",
)
def column_types(d):
    types = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype")) for c, t in quality.column_types(d.events.drop("ts"))]
    return d.events.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*types)).alias("e"), "rows").select("e.*", "rows")
