"""Joins: details, nearest station, weather of the day, integrity; and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalog.registry import query
from tarmac.operators import features as fe
from tarmac.operators import groupstats, joins, rollups, skew
from tarmac.plans import flows

_KM = """round(2 * 6371.0088e0 * asin(least(1e0, sqrt(
  pow(sin(radians(s.latitude - p.Latitude) / 2), 2)
  + cos(radians(p.Latitude)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - p.Longitude) / 2), 2)))), 6)"""

NEAREST = f"""SELECT p.Latitude, p.Longitude, arg_min(s.station_id, ({_KM}, s.station_id)) AS station_id, min({_KM}) AS distance_km
  FROM (SELECT DISTINCT Latitude, Longitude FROM accidents WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL) AS p,
    (SELECT * FROM stations WHERE country = 'GB') AS s GROUP BY p.Latitude, p.Longitude"""

WITH_WEATHER = f"""SELECT a.*, n.station_id, w.temp, w.tmin, w.tmax, w.prcp, w.snwd, w.wspd, w.pres, w.rhum, w.wpgt, w.tsun, w.cldc
  FROM accidents AS a LEFT JOIN ({NEAREST}) AS n ON a.Latitude = n.Latitude AND a.Longitude = n.Longitude
  LEFT JOIN weather AS w ON w.station_id = n.station_id AND w.time = a.Date"""


def gb_stations(d):
    return d.stations.where(F.col("country") == "GB")


def with_weather(d):
    return joins.attach_weather(d.accidents, gb_stations(d), d.weather)


@query(
    "accidents_left_vehicles",
    "Accident_Index:i Vehicle_Reference:f Year_x:f Year_y:f",
    """SELECT Accident_Index, Vehicle_Reference, a.Year AS Year_x, v.Year AS Year_y
       FROM accidents AS a LEFT JOIN vehicles AS v USING (Accident_Index)""",
    ["accidents", "vehicles"],
)
def accidents_left_vehicles(d):
    return joins.merge_details(d.accidents, d.vehicles)


@query(
    "accidents_left_vehicles_salted",
    "Accident_Index:i Vehicle_Reference:f",
    "SELECT Accident_Index, Vehicle_Reference FROM accidents AS a LEFT JOIN vehicles AS v USING (Accident_Index)",
    ["accidents", "vehicles"],
)
def accidents_left_vehicles_salted(d):
    # Low limits force the hot-key path at test scale.
    return skew.join_details(
        d.accidents.select("Accident_Index"), d.vehicles.select("Accident_Index", "Vehicle_Reference"), ["Accident_Index"], "left", 4, 0
    )


@query(
    "accidents_inner_vehicles",
    "Accident_Index:i Vehicle_Reference:i",
    "SELECT Accident_Index, Vehicle_Reference FROM accidents JOIN vehicles USING (Accident_Index)",
    ["accidents", "vehicles"],
)
def accidents_inner_vehicles(d):
    return joins.merge_details(d.accidents, d.vehicles, how="inner")


@query("nearest_station", "Latitude:f Longitude:f station_id:i distance_km:f", NEAREST, ["accidents", "stations"])
def nearest_station(d):
    return joins.nearest_station_join(d.accidents, gb_stations(d))


@query("nearest_station_by_grid", "Latitude:f Longitude:f station_id:i distance_km:f", NEAREST, ["accidents", "stations"])
def nearest_station_by_grid(d):
    return joins.nearest_station_join(d.accidents, gb_stations(d), max_broadcast=0)


@query(
    "weather_on_day",
    "station_id:i time:s temp:f prcp:f",
    "SELECT station_id, time, temp, prcp FROM weather",
    ["weather"],
)
def weather_on_day(d):
    twice = d.weather.unionByName(d.weather)
    return joins.weather_on_day(twice)


@query(
    "accidents_left_weather",
    "Accident_Index:i station_id:f temp:f prcp:f pres:f",
    f"SELECT Accident_Index, station_id, temp, prcp, pres FROM ({WITH_WEATHER})",
    ["accidents", "stations", "weather"],
)
def accidents_left_weather(d):
    return with_weather(d)


@query(
    "merged_accidents",
    "Accident_Index:i Vehicle_Reference:f make:s temp:f Speed_limit:f",
    f"""SELECT Accident_Index, Vehicle_Reference, make, temp, Speed_limit
        FROM ({WITH_WEATHER}) AS a LEFT JOIN vehicles AS v USING (Accident_Index)""",
    ["accidents", "vehicles", "stations", "weather"],
)
def merged_accidents(d):
    return joins.integrate(d.accidents, d.vehicles, gb_stations(d), d.weather)


@query(
    "year_across_tables",
    "matched_keys:i mismatches:i",
    """SELECT count(*) AS matched_keys, count(*) FILTER (WHERE NOT coalesce(a.Year = v.Year, false)) AS mismatches FROM accidents AS a
       JOIN (SELECT Accident_Index, Year FROM (SELECT *, row_number() OVER (PARTITION BY Accident_Index ORDER BY Vehicle_Reference, Year) AS rn
             FROM vehicles) WHERE rn = 1) AS v USING (Accident_Index)""",
    ["accidents", "vehicles"],
)
def year_across_tables(d):
    return joins.cross_table_mismatch(d.accidents, d.vehicles)


_KEYS = """SELECT key, max(l) AS in_left, max(r) AS in_right FROM (
  SELECT DISTINCT Accident_Index AS key, 1 AS l, 0 AS r FROM accidents UNION ALL SELECT DISTINCT Accident_Index, 0, 1 FROM vehicles) GROUP BY key"""


@query(
    "join_integrity",
    "left_keys:i right_keys:i matched_keys:i only_left:i only_right:i only_left_pct:f only_right_pct:f",
    f"""SELECT sum(in_left) AS left_keys, sum(in_right) AS right_keys, sum(in_left * in_right) AS matched_keys,
          sum(in_left * (1 - in_right)) AS only_left, sum(in_right * (1 - in_left)) AS only_right,
          only_left * 100e0 / left_keys AS only_left_pct, only_right * 100e0 / right_keys AS only_right_pct FROM ({_KEYS})""",
    ["accidents", "vehicles"],
)
def join_integrity(d):
    return joins.join_integrity(d.accidents, d.vehicles)


@query("key_overlap", "key:i in_left:i in_right:i", _KEYS, ["accidents", "vehicles"])
def key_overlap(d):
    return joins.key_overlap(d.accidents, d.vehicles)


@query(
    "keys_only_in_accidents",
    "Accident_Index:i",
    "SELECT Accident_Index FROM accidents EXCEPT SELECT Accident_Index FROM vehicles",
    ["accidents", "vehicles"],
)
def keys_only_in_accidents(d):
    return joins.key_overlap(d.accidents, d.vehicles).where("in_left = 1 AND in_right = 0").select(F.col("key").alias("Accident_Index"))


@query(
    "matched_keys",
    "Accident_Index:i",
    "SELECT Accident_Index FROM accidents INTERSECT SELECT Accident_Index FROM vehicles",
    ["accidents", "vehicles"],
)
def matched_keys(d):
    return d.accidents.select("Accident_Index").intersect(d.vehicles.select("Accident_Index"))


@query(
    "code_map_lookup",
    "Accident_Index:i code:i",
    """SELECT Accident_Index, CASE Road_Type WHEN 'Single carriageway' THEN 1 WHEN 'Dual carriageway' THEN 2 WHEN 'Roundabout' THEN 0
         WHEN 'One way street' THEN 1 WHEN 'Slip road' THEN 2 WHEN 'Unknown' THEN 1 ELSE 1 END AS code FROM accidents""",
    ["accidents"],
)
def code_map_lookup(d):
    return fe.road_type_code(d.accidents, target="code")


_WEIGHT = "CASE Accident_Severity WHEN 'Slight' THEN 1e0 WHEN 'Serious' THEN 2e0 WHEN 'Fatal' THEN 3e0 END"


@query(
    "group_stat_map_back",
    "Accident_Index:i district_rate:f district_volume:f",
    f"""WITH g AS (SELECT Local_Authority_District AS d, avg({_WEIGHT}) AS m, count(*) AS n FROM accidents_admin
                   WHERE Local_Authority_District IS NOT NULL GROUP BY 1)
        SELECT a.Accident_Index, coalesce(g.m, 1e0) AS district_rate, coalesce(g.n, (SELECT median(n) FROM g)) AS district_volume
        FROM accidents_admin AS a LEFT JOIN g ON a.Local_Authority_District = g.d""",
    ["accidents_admin"],
)
def group_stat_map_back(d):
    encoding = groupstats.fit_group_encoding(d.accidents_admin, ["Local_Authority_District"])
    return encoding.attach(d.accidents_admin, "Local_Authority_District", "district_rate", "district_volume")


_FLAGSHIP_SQL = f"""SELECT Speed_limit, is_dark, count(*) AS Accidents,
    avg(CASE WHEN Accident_Severity IN ('Fatal', 'Serious') THEN 1e0 ELSE 0e0 END) AS SevereRate,
    sum(adverse * is_dark) AS adverse_dark, avg(risk * CASE WHEN temp < 5 THEN 1.5e0 ELSE 1e0 END) AS mean_risk,
    count(temp) AS with_temp
  FROM (SELECT *, CASE WHEN contains(coalesce(Light_Conditions, ''), 'Darkness') THEN 1 ELSE 0 END AS is_dark,
          CASE WHEN coalesce(prcp > 0, false) OR coalesce(snwd > 0, false) OR coalesce(cldc >= 6, false) THEN 1 ELSE 0 END AS adverse,
          floor((CASE Speed_limit WHEN 20 THEN 1 WHEN 30 THEN 2 WHEN 40 THEN 3 WHEN 50 THEN 4 WHEN 60 THEN 5 WHEN 70 THEN 6 END)
            * (CASE coalesce(Road_Type, 'Single carriageway') WHEN 'Single carriageway' THEN 1.5e0 WHEN 'Dual carriageway' THEN 1e0
               WHEN 'Roundabout' THEN 0.8e0 WHEN 'One way street' THEN 0.9e0 WHEN 'Slip road' THEN 0.7e0 ELSE 1e0 END)) AS risk
        FROM ({WITH_WEATHER}) WHERE Speed_limit IN (20, 30, 40, 50, 60, 70) AND Latitude IS NOT NULL AND Longitude IS NOT NULL)
  GROUP BY Speed_limit, is_dark"""


@query(
    "severe_rate_by_conditions",
    "Speed_limit:i is_dark:i Accidents:i SevereRate:f adverse_dark:i mean_risk:f with_temp:i",
    _FLAGSHIP_SQL,
    ["accidents", "stations", "weather"],
)
def severe_rate_by_conditions(d):
    rows = rollups.severe_flag(flows.severe_rate_by_conditions(with_weather(d)))
    return rows.groupBy("Speed_limit", "is_dark").agg(
        F.count(F.lit(1)).alias("Accidents"),
        F.avg("SevereFlag").alias("SevereRate"),
        F.sum("adverse_dark").alias("adverse_dark"),
        F.avg("temp_road_risk").alias("mean_risk"),
        F.count("temp").alias("with_temp"),
    )
