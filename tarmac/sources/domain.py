"""The test tables seen as accidents, vehicles, stations and weather.

Each view is one SQL text that both Spark and the SQL oracle can read; only day names differ,
and they go through ``{dayname(..)}``-style shims. Spark prunes unread columns, so a view
costs only what a query uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tarmac import presets

#: Columns of the views, for oracles about every column.
ACCIDENT_COLUMNS = (
    "Accident_Index Reporter_Key Accident_Severity Date Date_Text Time Year Day_of_Week Speed_limit Road_Type Light_Conditions "
    "Weather_Conditions Road_Surface_Conditions Urban_or_Rural_Area Latitude Longitude Number_of_Vehicles Number_of_Casualties "
    "X1st_Road_Class X2nd_Road_Class Carriageway_Hazards Site_Note Junction_Control Junction_Detail Pedestrian_Crossing "
    "Did_Police_Officer_Attend_Scene_of_Accident"
).split()
VEHICLE_COLUMNS = (
    "Accident_Index Vehicle_Reference make Vehicle_Type Engine_Capacity_CC Age_of_Driver Age_Band_of_Driver Sex_of_Driver "
    "Age_of_Vehicle Year Propulsion_Code Towing_and_Articulation X1st_Point_of_Impact Vehicle_Manoeuvre Junction_Location "
    "Journey_Purpose_of_Driver Driver_Home_Area_Type"
).split()

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "labels"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(expr: str, values: Sequence[str | None]) -> str:
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)
    )
    return f"CASE ({expr}) % {len(values)} {arms} END"


def _weekday_name(day: str, engine: str) -> str:
    if engine == "spark":
        return f"date_format({day}, 'EEEE')"
    return f"dayname({day})"


def _accidents(engine: str) -> str:
    k, day = "o_orderkey", "CAST(o_orderdate AS DATE)"
    return f"""
SELECT o_orderkey AS Accident_Index,
  o_custkey AS Reporter_Key,
  CASE WHEN {k} % 499 = 3 THEN 'Unclassified' WHEN {k} % 100 = 0 THEN 'Fatal'
       WHEN {k} % 100 <= 14 THEN 'Serious' ELSE 'Slight' END AS Accident_Severity,
  {day} AS Date,
  CASE WHEN {k} % 83 = 0 THEN 'no date' WHEN {k} % 79 = 0 THEN NULL ELSE CAST({day} AS STRING) END AS Date_Text,
  CASE WHEN {k} % 89 = 0 THEN 'unknown' WHEN {k} % 71 = 0 THEN NULL
       ELSE lpad(CAST({k} % 24 AS STRING), 2, '0') || ':' || lpad(CAST({k} % 60 AS STRING), 2, '0') END AS Time,
  CAST(CASE WHEN {k} % 103 = 0 THEN year({day}) + 1 WHEN {k} % 107 = 0 THEN NULL ELSE year({day}) END AS INT) AS Year,
  CASE WHEN {k} % 97 = 0 THEN 'Someday' WHEN {k} % 109 = 0 THEN 'Monday' WHEN {k} % 211 = 0 THEN NULL
       ELSE {_weekday_name(day, engine)} END AS Day_of_Week,
  CAST(CASE WHEN {k} % 53 = 0 THEN NULL WHEN {k} % 101 = 0 THEN 15 ELSE 20 + 10 * (({k} * 7 + 3) % 13 % 6) END AS INT)
       AS Speed_limit,
  CASE WHEN {k} % 47 = 0 THEN NULL ELSE {_pick(f'{k} * 5 + 1', ['Single carriageway', 'Single carriageway',
       'Single carriageway', 'Dual carriageway', 'Roundabout', 'One way street', 'Slip road', 'Unknown'])} END
       AS Road_Type,
  CASE WHEN {k} % 61 = 0 THEN NULL ELSE {_pick(f'{k} * 3 + 2', ['Daylight', 'Daylight', 'Daylight',
       'Darkness - lights lit', 'Darkness - no lights'])} END AS Light_Conditions,
  CASE WHEN {k} % 67 = 0 THEN NULL ELSE {_pick(f'{k} * 4 + 1', ['Fine no high winds', 'Fine no high winds',
       'Fine no high winds', 'Fine no high winds', 'Raining no high winds', 'Snowing no high winds',
       'Fog or mist'])} END AS Weather_Conditions,
  CASE WHEN {k} % 59 = 0 THEN NULL ELSE {_pick(f'{k} * 2 + 1', ['Dry', 'Dry', 'Wet or damp', 'Snow', 'Dry'])} END
       AS Road_Surface_Conditions,
  CASE WHEN {k} % 73 = 0 THEN NULL ELSE {_pick(k, ['Urban', 'Rural', 'Unallocated', 'built-up area'])} END
       AS Urban_or_Rural_Area,
  CASE WHEN {k} % 149 = 0 THEN NULL WHEN {k} % 331 = 0 THEN 65e0
       ELSE 49.5e0 + (o_custkey * 37 % 1100) / 100e0 END AS Latitude,
  CASE WHEN {k} % 151 = 0 THEN NULL WHEN {k} % 337 = 0 THEN 7e0
       ELSE -7.5e0 + (o_custkey * 53 % 900) / 100e0 END AS Longitude,
  CAST(CASE WHEN {k} % 313 = 0 THEN 0 ELSE 1 + {k} % 4 END AS INT) AS Number_of_Vehicles,
  CAST(CASE WHEN {k} % 887 = 0 THEN 60 ELSE 1 + ({k} * 3 + {k} % 100) % 7 END AS INT) AS Number_of_Casualties,
  {_pick(f'{k} * 11', ['A', 'B', 'C', 'M', 'Unclassified', 'A(M)', None])} AS X1st_Road_Class,
  {_pick(f'{k} * 3', ['A', 'B', None, None, 'C'])} AS X2nd_Road_Class,
  CASE WHEN {k} % 50 = 0 THEN 'Dog on road' ELSE NULL END AS Carriageway_Hazards,
  CASE WHEN {k} % 5 < 2 THEN 'Roadworks' ELSE NULL END AS Site_Note,
  {_pick(f'{k} * 7 + 2', [*presets.JUNCTION_CONTROL_CODES, 'Other text', None])} AS Junction_Control,
  {_pick(f'{k} * 5 + 3', [*presets.JUNCTION_DETAIL_CODES, 'Other text', None])} AS Junction_Detail,
  {_pick(f'{k} * 2 + 1', ['None within 50 metres', 'Zebra', None])} AS Pedestrian_Crossing,
  CAST(1 + {k} % 3 AS INT) AS Did_Police_Officer_Attend_Scene_of_Accident
FROM orders"""


def _vehicles(engine: str) -> str:
    return f"""
SELECT CASE WHEN l_partkey % 41 = 0 THEN -1 - l_orderkey ELSE l_orderkey END AS Accident_Index,
  l_linenumber AS Vehicle_Reference,
  CASE WHEN p_partkey % 113 = 0 THEN NULL ELSE p_brand END AS make,
  CASE WHEN l_suppkey % 29 = 0 THEN NULL WHEN p_size % 13 = 0 THEN 'Tram' ELSE
       CASE p_type WHEN 'ECONOMY' THEN 'Car' WHEN 'LARGE' THEN 'Goods 7.5 tonnes mgw and over'
            WHEN 'MEDIUM' THEN 'Motorcycle over 500cc' WHEN 'PROMO' THEN 'Taxi/Private hire car'
            WHEN 'SMALL' THEN 'Motorcycle 125cc and under' ELSE 'Van / Goods 3.5 tonnes mgw or under' END END
       AS Vehicle_Type,
  CAST(CASE WHEN p_size % 11 = 5 THEN NULL WHEN p_size % 17 = 0 THEN 0 ELSE p_size * 100 END AS INT)
       AS Engine_Capacity_CC,
  CAST(CASE WHEN l_suppkey % 31 = 0 THEN NULL ELSE floor(l_quantity) + 17 END AS INT) AS Age_of_Driver,
  {_pick('l_partkey * 3 + l_linenumber', [*presets.AGE_MIDPOINTS, presets.SENTINEL, '999', '26-35', None])}
       AS Age_Band_of_Driver,
  {_pick('l_suppkey + l_linenumber', ['Male', 'Female', 'M', 'F', '1', '2', '3', 'Not known', 'male ', 'data?', None])}
       AS Sex_of_Driver,
  CAST(CASE WHEN l_partkey % 83 = 0 THEN -1 WHEN l_partkey % 19 = 0 THEN NULL ELSE (l_linenumber * 3 + l_partkey) % 23 END
       AS INT) AS Age_of_Vehicle,
  CAST(year(l_shipdate) AS INT) AS Year,
  CASE l_returnflag WHEN 'A' THEN 'Petrol' WHEN 'N' THEN 'Heavy oil' ELSE NULL END AS Propulsion_Code,
  {_pick('l_suppkey * 2 + l_linenumber', [*presets.TOWING_CODES, 'Sledge', None])} AS Towing_and_Articulation,
  {_pick('l_partkey + l_linenumber', [*presets.IMPACT_CODES, 'Roof', None])} AS X1st_Point_of_Impact,
  {_pick('l_partkey * 7 + l_linenumber', [*presets.MANOEUVRE_GROUPS, 'Flying', None])} AS Vehicle_Manoeuvre,
  {_pick('l_suppkey * 3 + l_linenumber', [*presets.JUNCTION_LOCATION_CODES, 'Elsewhere', None])} AS Junction_Location,
  {_pick('l_suppkey + l_partkey', [*presets.JOURNEY_CODES, 'Holiday', None])} AS Journey_Purpose_of_Driver,
  {_pick('l_partkey * 5 + l_linenumber', [*presets.HOME_AREA_CODES, None])} AS Driver_Home_Area_Type
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _stations(engine: str) -> str:
    return """
SELECT s_suppkey AS station_id, CASE WHEN s_suppkey % 10 = 9 THEN 'FR' ELSE 'GB' END AS country,
  49.755e0 + (s_suppkey * 29 % 1050) / 100e0 AS latitude,
  -7.255e0 + (s_suppkey * 71 % 850) / 100e0 AS longitude
FROM supplier"""


def _weather(engine: str) -> str:
    return """
SELECT station_id, time, year,
  CASE WHEN mk % 7 = 0 THEN NULL ELSE floor(sq / n) * 0.5e0 - 6e0 END AS temp,
  CASE WHEN mk % 7 = 1 THEN NULL ELSE lo * 0.5e0 - 9e0 END AS tmin,
  CASE WHEN mk % 7 = 2 THEN NULL ELSE hi * 0.5e0 + 2e0 END AS tmax,
  CASE WHEN mk % 11 = 0 THEN NULL WHEN mk % 3 = 0 THEN 0e0 ELSE (mk % 40) * 0.25e0 END AS prcp,
  CASE WHEN mk % 10 < 6 THEN NULL WHEN mk % 2 = 0 THEN 0e0 ELSE (mk % 30) * 1e0 END AS snwd,
  (mk % 121) * 1e0 AS wspd,
  880e0 + (mk % 170) AS pres,
  CASE WHEN mk % 4 = 0 THEN NULL ELSE (mk % 101) * 1e0 END AS rhum,
  (mk % 113) * 1e0 AS wpgt,
  (mk % 1500) * 1e0 AS tsun,
  CASE WHEN mk % 13 = 0 THEN NULL ELSE (mk % 9) * 1e0 END AS cldc
FROM (SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS time, CAST(year(l_shipdate) AS INT) AS year,
        sum(l_quantity) AS sq, count(*) AS n, min(l_orderkey) AS mk, min(l_quantity) AS lo, max(l_quantity) AS hi
      FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE), CAST(year(l_shipdate) AS INT)) AS days"""


def _accidents_admin(engine: str) -> str:
    return """
SELECT accidents.*,
  CASE WHEN Accident_Index % 37 = 0 THEN NULL ELSE c_nationkey END AS Local_Authority_District,
  CASE WHEN Accident_Index % 43 = 0 THEN NULL ELSE n_regionkey END AS Local_Authority_Highway
FROM accidents LEFT JOIN customer ON Reporter_Key = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"""


def _scores(engine: str) -> str:
    k = "l_orderkey * 8 + l_linenumber"
    return f"""
SELECT row_id, label, wf / (wf + ws + wl) AS p_fatal, ws / (wf + ws + wl) AS p_serious, wl / (wf + ws + wl) AS p_slight
FROM (SELECT {k} AS row_id,
        CASE WHEN l_partkey % 25 = 0 THEN 'Fatal' WHEN l_partkey % 25 <= 5 THEN 'Serious' ELSE 'Slight' END AS label,
        (1 + (l_partkey * 17 + l_suppkey) % 61) * (CASE WHEN l_partkey % 25 = 0 THEN 3e0 ELSE 1e0 END) AS wf,
        (1 + (l_partkey * 31 + l_suppkey * 7) % 97) * (CASE WHEN l_partkey % 25 BETWEEN 1 AND 5 THEN 2e0 ELSE 1e0 END)
          AS ws,
        (20 + (l_partkey * 13 + l_suppkey * 5) % 149) * 1e0 AS wl
      FROM lineitem) AS raw_scores"""


VIEWS = {
    "accidents": (_accidents, ["orders"]),
    "vehicles": (_vehicles, ["lineitem", "part"]),
    "stations": (_stations, ["supplier"]),
    "weather": (_weather, ["lineitem"]),
    "accidents_admin": (_accidents_admin, ["accidents", "customer", "nation"]),
    "scores": (_scores, ["lineitem"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a lazy DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    needs = VIEWS[name][1]
    return view_over(spark, name, {n: view(spark, sf_dir, n) for n in needs})


def view_over(spark: SparkSession, name: str, frames: dict[str, DataFrame]) -> DataFrame:
    """A domain view over given inputs, which may be streams."""
    sql = VIEWS[name][0]("spark")
    # spark.sql binds DataFrames to {name}; a view text names its inputs bare after FROM / JOIN.
    for n in frames:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}} AS {n}").replace(f"JOIN {n} ", f"JOIN {{{n}}} AS {n} ")
    return spark.sql(sql, **frames)


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the SQL oracle, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for need in VIEWS[name][1]:
                add(need)
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0]('oracle')})" for n in ordered)
