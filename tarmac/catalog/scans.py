"""Sources, sinks and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalog.registry import query
from tarmac.operators import balance, quality, rollups
from tarmac.session import new_path
from tarmac.sources import snapshots, tables

_CSV = "Accident_Index long, Accident_Severity string, Date_Text string, Time string, Speed_limit int, Latitude double"


@query(
    "csv_scan",
    "Accident_Index:i Accident_Severity:s Date_Text:s Time:s Speed_limit:f Latitude:f",
    "SELECT Accident_Index, Accident_Severity, Date_Text, Time, Speed_limit, Latitude FROM accidents",
    ["accidents"],
)
def csv_scan(d):
    path = new_path(d.spark, "csv")
    rows = d.accidents.select("Accident_Index", "Accident_Severity", "Date_Text", "Time", "Speed_limit", "Latitude")
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tables.read_csv(d.spark, path, _CSV)


@query(
    "csv_scan_bad_numbers",
    "bad_time:i rows:i",
    "SELECT count(*) FILTER (WHERE Time IS NOT NULL AND TRY_CAST(substr(Time, 1, 2) AS INT) IS NULL) AS bad_time, count(*) AS rows FROM accidents",
    ["accidents"],
)
def csv_scan_bad_numbers(d):
    path = new_path(d.spark, "csv")
    d.accidents.select("Accident_Index", F.substring("Time", 1, 2).alias("hour"), "Time").write.option("header", True).csv(path)
    typed = tables.read_csv(d.spark, path, "Accident_Index long, hour int, Time string")
    return typed.agg(
        F.count_if(F.col("Time").isNotNull() & F.col("hour").isNull()).alias("bad_time"), F.count(F.lit(1)).alias("rows")
    )


@query(
    "relational_stations",
    "station_id:i longitude:f latitude:f",
    "SELECT station_id, longitude, latitude FROM stations WHERE country = 'GB'",
    ["stations"],
)
def relational_stations(d):
    return tables.project(d.stations, ["station_id", "longitude", "latitude"], F.col("country") == "GB")


@query(
    "stage_snapshot",
    "Accident_Index:i Accident_Severity:s Speed_limit:i",
    "SELECT Accident_Index, Accident_Severity, Speed_limit FROM accidents WHERE Speed_limit IN (20, 30, 40, 50, 60, 70)",
    ["accidents"],
)
def stage_snapshot(d):
    rows = d.accidents.select("Accident_Index", "Accident_Severity", "Speed_limit")
    return snapshots.write_snapshot(rows.where(F.col("Speed_limit").isin(20, 30, 40, 50, 60, 70)), new_path(d.spark, "stage"))


@query(
    "weather_store",
    "station_id:i year:i days:i temp_sum:f",
    """SELECT station_id, year, count(*) AS days, coalesce(sum(temp), 0) AS temp_sum FROM weather
       WHERE year BETWEEN 1997 AND 1999 GROUP BY station_id, year""",
    ["weather"],
)
def weather_store(d):
    stored = snapshots.write_weather_store(d.weather, new_path(d.spark, "weather"))
    return (
        stored.where(F.col("year").between(1997, 1999))
        .groupBy("station_id", "year")
        .agg(F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("temp"), F.lit(0.0)).alias("temp_sum"))
    )


@query(
    "findings_sink",
    "check_name:s subject:s metric:s value:f is_issue:i",
    """SELECT 'range' AS check_name, 'Latitude' AS subject, 'violations' AS metric,
         count(*) FILTER (WHERE Latitude < 49 OR Latitude > 61) AS value, value > 0 AS is_issue FROM accidents
       UNION ALL SELECT 'range', 'Longitude', 'violations', count(*) FILTER (WHERE Longitude < -11 OR Longitude > 2) AS v, v > 0
       FROM accidents
       UNION ALL SELECT 'range', 'Speed_limit', 'violations',
         count(*) FILTER (WHERE Speed_limit NOT IN (20, 30, 40, 50, 60, 70)) AS v, v > 0 FROM accidents
       UNION ALL SELECT 'business_rule', 'Accident_Severity', 'violations',
         count(*) FILTER (WHERE Accident_Severity IS NULL OR Accident_Severity NOT IN ('Fatal', 'Serious', 'Slight')) AS v, v > 0
       FROM accidents
       UNION ALL SELECT 'business_rule', 'Number_of_Casualties', 'violations',
         count(*) FILTER (WHERE Number_of_Casualties > 50) AS v, v > 0 FROM accidents""",
    ["accidents"],
)
def findings_sink(d):
    return snapshots.write_findings(quality.generic_checks(d.accidents), new_path(d.spark, "findings"))


_SPLIT_SQL = """SELECT Accident_Severity AS label, CASE WHEN rn <= floor(n * 0.2e0 + 0.5e0) THEN 'test'
    WHEN rn <= floor(n * (0.2e0 + 0.4e0) + 0.5e0) THEN 'val' ELSE 'train' END AS split FROM (
  SELECT Accident_Severity, row_number() OVER (PARTITION BY Accident_Severity ORDER BY h) AS rn,
    count(*) OVER (PARTITION BY Accident_Severity) AS n FROM (
    SELECT Accident_Severity, CAST('0x' || substr(md5('42:' || CAST(Accident_Index AS STRING)), 1, 15) AS BIGINT) AS h
    FROM accidents))"""


def _splits(d):
    return balance.train_val_test(d.accidents, "Accident_Severity", "Accident_Index").withColumnRenamed("Accident_Severity", "label")


@query(
    "run_metadata",
    "n_features:i total_rows:i feature_names:s class_distribution:s config:s",
    f"""SELECT 2 AS n_features, sum(n) AS total_rows, '["Speed_limit","Latitude"]' AS feature_names,
          '[' || string_agg('{{"split":"' || split || '","label":"' || label || '","n":' || CAST(n AS STRING) || '}}', ','
                            ORDER BY split, label) || ']' AS class_distribution,
          '{{"random_state":"42","test_size":"0.2"}}' AS config
        FROM (SELECT split, label, count(*) AS n FROM ({_SPLIT_SQL}) GROUP BY split, label)""",
    ["accidents"],
)
def run_metadata(d):
    return snapshots.run_metadata(d.spark, {"test_size": 0.2, "random_state": 42}, _splits(d), ["Speed_limit", "Latitude"])


@query(
    "split_summary",
    "split:s label:s n:i pct:f",
    f"""SELECT split, label, count(*) AS n, count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY split) AS pct
        FROM ({_SPLIT_SQL}) GROUP BY split, label""",
    ["accidents"],
)
def split_summary(d):
    return rollups.split_totals(_splits(d))


@query(
    "feature_matrix_with_labels",
    "Accident_Index:i Speed_limit:f Latitude:f Accident_Severity:s SevereFlag:f",
    """SELECT Accident_Index, Speed_limit, Latitude, Accident_Severity,
         CASE WHEN Accident_Severity IN ('Fatal', 'Serious') THEN 1e0 ELSE 0e0 END AS SevereFlag FROM accidents""",
    ["accidents"],
)
def feature_matrix_with_labels(d):
    features = d.accidents.select("Accident_Index", "Speed_limit", "Latitude")
    return rollups.attach_labels(features, d.accidents, "Accident_Index")


@query(
    "json_scan",
    "event_id:i k:i",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_scan(d):
    path = new_path(d.spark, "json")
    rows = d.events.select("event_id", F.from_json("props", "k long").alias("props"))
    rows.write.json(path)
    return tables.read_json(d.spark, path, "event_id long, props struct<k: long>", multi_line=False).select("event_id", "props.k")


@query(
    "balanced_table_cache",
    "label:s n:i",
    """SELECT Accident_Severity AS label, least(count(*), CASE Accident_Severity WHEN 'Slight' THEN
         (SELECT count(*) FROM accidents WHERE Accident_Severity = 'Serious') ELSE count(*) END) AS n
       FROM accidents GROUP BY Accident_Severity""",
    ["accidents"],
)
def balanced_table_cache(d):
    counts = balance.class_counts(d.accidents, "Accident_Severity")
    path = new_path(d.spark, "balanced")

    def build():
        return balance.undersample_to(
            d.accidents.select("Accident_Index", "Accident_Severity"), "Accident_Severity", "Accident_Index", {"Slight": counts["Serious"]}
        )

    snapshots.read_or_create(d.spark, path, build)
    cached = snapshots.read_or_create(
        d.spark, path, build, lambda df: snapshots.check_balanced(df, "Accident_Severity", {"Serious": counts["Serious"]}, min_percent=1.0)
    )
    return cached.groupBy(F.col("Accident_Severity").alias("label")).agg(F.count(F.lit(1)).alias("n"))
