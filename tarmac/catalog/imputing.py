"""Missing values, outliers, encoding, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalog.registry import query
from tarmac.operators import impute

_HOLED = "SELECT Accident_Index, Speed_limit, Latitude, Road_Type, Time FROM accidents"


def _holed(d):
    return d.accidents.select("Accident_Index", "Speed_limit", "Latitude", "Road_Type", "Time")


@query(
    "impute_median_or_unknown",
    "Accident_Index:i Speed_limit:f Latitude:f Road_Type:s Time:s",
    """SELECT Accident_Index, coalesce(Speed_limit, (SELECT median(Speed_limit) FROM accidents)) AS Speed_limit,
         coalesce(Latitude, (SELECT median(Latitude) FROM accidents)) AS Latitude, coalesce(Road_Type, 'Unknown') AS Road_Type,
         coalesce(Time, 'Unknown') AS Time FROM accidents""",
    ["accidents"],
)
def impute_median_or_unknown(d):
    return impute.handle_missing(_holed(d))


@query(
    "impute_mean",
    "Accident_Index:i Latitude:f Longitude:f",
    """SELECT Accident_Index, coalesce(Latitude, (SELECT avg(Latitude) FROM accidents)) AS Latitude,
         coalesce(Longitude, (SELECT avg(Longitude) FROM accidents)) AS Longitude FROM accidents""",
    ["accidents"],
)
def impute_mean(d):
    return impute.impute_mean(d.accidents)


def _mode(column):
    return f"(SELECT {column} FROM accidents WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, CAST({column} AS STRING) LIMIT 1)"


@query(
    "impute_mode",
    "Accident_Index:i Speed_limit:i Time:s Pedestrian_Crossing:s",
    f"""SELECT Accident_Index, coalesce(Speed_limit, {_mode('Speed_limit')}) AS Speed_limit, coalesce(Time, {_mode('Time')}) AS Time,
          coalesce(Pedestrian_Crossing, {_mode('Pedestrian_Crossing')}) AS Pedestrian_Crossing FROM accidents""",
    ["accidents"],
)
def impute_mode(d):
    return impute.impute_mode(d.accidents, ["Speed_limit", "Time", "Pedestrian_Crossing"])


@query(
    "impute_group_mean",
    "station_id:i time:s temp:f",
    """SELECT station_id, w.time, coalesce(temp, m) AS temp FROM weather AS w
       LEFT JOIN (SELECT time, avg(temp) AS m FROM weather WHERE temp IS NOT NULL GROUP BY time) AS g ON w.time = g.time""",
    ["weather"],
)
def impute_group_mean(d):
    return impute.impute_group_mean(d.weather, "temp", "time")


@query(
    "impute_for_balancing",
    "Accident_Index:i Speed_limit:f Road_Type:s",
    f"""SELECT Accident_Index, coalesce(Speed_limit, (SELECT median(Speed_limit) FROM accidents)) AS Speed_limit,
          coalesce(Road_Type, {_mode('Road_Type')}) AS Road_Type FROM accidents""",
    ["accidents"],
)
def impute_for_balancing(d):
    return impute.impute_for_balancing(d.accidents.select("Accident_Index", "Speed_limit", "Road_Type"), ["Speed_limit", "Road_Type"])


@query(
    "impute_ordered",
    "Accident_Index:i Speed_limit:f Longitude:f has_note:i",
    """SELECT Accident_Index, coalesce(last_value(Speed_limit IGNORE NULLS) OVER f, first_value(Speed_limit IGNORE NULLS) OVER b) AS Speed_limit,
         coalesce(last_value(Longitude IGNORE NULLS) OVER f, first_value(Longitude IGNORE NULLS) OVER b) AS Longitude, 0 AS has_note
       FROM accidents WINDOW f AS (ORDER BY Accident_Index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (ORDER BY Accident_Index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    ["accidents"],
)
def impute_ordered(d):
    rows = d.accidents.select("Accident_Index", "Speed_limit", "Longitude", F.col("Site_Note").isNull().cast("int").alias("flag"), F.when(F.col("Site_Note").isNotNull(), 1).alias("note"))
    out = impute.impute_ordered(rows, ["Speed_limit", "Longitude", "note"], "Accident_Index")
    return out.withColumn("has_note", F.lit(int("note" in out.columns)))


_CLIP_BOUNDS = """WITH b AS (SELECT quantile_cont(CAST(Number_of_Casualties AS DOUBLE), 0.25) AS c1, quantile_cont(CAST(Number_of_Casualties AS DOUBLE), 0.75) AS c3,
    quantile_cont(CAST(Number_of_Vehicles AS DOUBLE), 0.25) AS v1, quantile_cont(CAST(Number_of_Vehicles AS DOUBLE), 0.75) AS v3 FROM accidents)"""


@query(
    "outlier_clip",
    "Accident_Index:i Number_of_Casualties:f Number_of_Vehicles:f Latitude:f",
    f"""{_CLIP_BOUNDS} SELECT Accident_Index, greatest(c1 - 1.5e0 * (c3 - c1), least(c3 + 1.5e0 * (c3 - c1), Number_of_Casualties)) AS Number_of_Casualties,
          greatest(v1 - 1.5e0 * (v3 - v1), least(v3 + 1.5e0 * (v3 - v1), Number_of_Vehicles)) AS Number_of_Vehicles, Latitude FROM accidents, b""",
    ["accidents"],
)
def outlier_clip(d):
    # Latitude has nulls and is left alone; the key is an excluded column.
    return impute.outlier_clip(d.accidents.select("Accident_Index", "Number_of_Casualties", "Number_of_Vehicles", "Latitude"))[0]


@query(
    "outlier_clip_stats",
    "column:s n_outliers:i pct_outliers:f lower_bound:f upper_bound:f",
    f"""{_CLIP_BOUNDS} SELECT 'Number_of_Casualties' AS "column", count(*) AS n_outliers, round(count(*) * 100e0 / (SELECT count(*) FROM accidents), 2) AS pct_outliers,
          c1 - 1.5e0 * (c3 - c1) AS lower_bound, c3 + 1.5e0 * (c3 - c1) AS upper_bound FROM accidents, b
        WHERE Number_of_Casualties < c1 - 1.5e0 * (c3 - c1) OR Number_of_Casualties > c3 + 1.5e0 * (c3 - c1) GROUP BY c1, c3""",
    ["accidents"],
)
def outlier_clip_stats(d):
    return impute.outlier_clip(d.accidents.select("Accident_Index", "Number_of_Casualties", "Number_of_Vehicles", "Latitude"))[1]


@query(
    "outlier_remove",
    "Accident_Index:i Number_of_Casualties:i Latitude:f",
    """WITH q1 AS (SELECT quantile_cont(CAST(Number_of_Casualties AS DOUBLE), 0.25) AS a, quantile_cont(CAST(Number_of_Casualties AS DOUBLE), 0.75) AS b FROM accidents),
       s1 AS (SELECT accidents.* FROM accidents, q1 WHERE Number_of_Casualties BETWEEN a - 1.5e0 * (b - a) AND b + 1.5e0 * (b - a)),
       q2 AS (SELECT quantile_cont(Latitude, 0.25) AS a, quantile_cont(Latitude, 0.75) AS b FROM s1)
       SELECT Accident_Index, Number_of_Casualties, Latitude FROM s1, q2 WHERE Latitude BETWEEN a - 1.5e0 * (b - a) AND b + 1.5e0 * (b - a)""",
    ["accidents"],
)
def outlier_remove(d):
    return impute.outlier_remove(d.accidents, ["Number_of_Casualties", "Latitude"])


_LIGHT = ["Darkness - lights lit", "Darkness - no lights", "Daylight"]


@query(
    "onehot_encode",
    "Accident_Index:i light_Daylight:i lit:i dark:i",
    """SELECT Accident_Index, CASE WHEN Light_Conditions = 'Daylight' THEN 1 ELSE 0 END AS light_Daylight,
         CASE WHEN Light_Conditions = 'Darkness - lights lit' THEN 1 ELSE 0 END AS lit, CASE WHEN Light_Conditions = 'Darkness - no lights' THEN 1 ELSE 0 END AS dark
       FROM accidents""",
    ["accidents"],
)
def onehot_encode(d):
    rows = d.accidents.select("Accident_Index", F.col("Light_Conditions").alias("light"))
    out = impute.encode_categorical(rows, ["light"], "onehot", 10)
    return out.withColumnsRenamed({"light_Darkness - lights lit": "lit", "light_Darkness - no lights": "dark"})


@query(
    "label_encode",
    "Accident_Index:i Vehicle_Reference:i Vehicle_Manoeuvre:i make:i",
    """WITH m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(Vehicle_Manoeuvre, 'None') AS v FROM vehicles)),
         k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(make, 'None') AS v FROM vehicles))
       SELECT Accident_Index, Vehicle_Reference, m.code AS Vehicle_Manoeuvre, k.code AS make FROM vehicles
       JOIN m ON coalesce(Vehicle_Manoeuvre, 'None') = m.v JOIN k ON coalesce(make, 'None') = k.v""",
    ["vehicles"],
)
def label_encode(d):
    rows = d.vehicles.select("Accident_Index", "Vehicle_Reference", "Vehicle_Manoeuvre", "make")
    return impute.encode_categorical(rows, ["Vehicle_Manoeuvre", "make"], method="label")


@query(
    "standard_scale",
    "Accident_Index:i Latitude:f Number_of_Casualties:f",
    """SELECT Accident_Index, coalesce((Latitude - (SELECT avg(Latitude) FROM t)) / (SELECT stddev_pop(Latitude) FROM t), 0) AS Latitude,
         coalesce((Number_of_Casualties - (SELECT avg(Number_of_Casualties) FROM t)) / (SELECT stddev_pop(Number_of_Casualties) FROM t), 0) AS Number_of_Casualties
       FROM accidents""".replace("FROM t)", "FROM (SELECT * FROM accidents WHERE Number_of_Vehicles > 1))"),
    ["accidents"],
)
def standard_scale(d):
    # Fitted on a part of the rows, applied to all.
    columns = ["Latitude", "Number_of_Casualties"]
    return impute.Scaler.fit(d.accidents.where("Number_of_Vehicles > 1"), columns).transform(d.accidents)
