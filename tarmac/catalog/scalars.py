"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import presets
from tarmac.catalog.registry import case_map, query
from tarmac.functions import scalar as fx


@query(
    "contains_and_regex_flags",
    "Accident_Index:i dark:i urban:i time_ok:i",
    r"""SELECT Accident_Index, CASE WHEN contains(coalesce(Light_Conditions, ''), 'Darkness') THEN 1 ELSE 0 END AS dark,
         CASE WHEN regexp_matches(lower(coalesce(Urban_or_Rural_Area, '')), 'urban|built') THEN 1 ELSE 0 END AS urban,
         CASE WHEN regexp_matches(coalesce(Time, ''), '^\d{1,2}:\d{2}$') THEN 1 ELSE 0 END AS time_ok FROM accidents""",
    ["accidents"],
)
def contains_and_regex_flags(d):
    return d.accidents.select(
        "Accident_Index",
        fx.flag(fx.contains_any("Light_Conditions", ["Darkness", "darkness"])).alias("dark"),
        fx.flag(fx.matches("Urban_or_Rural_Area", "(?i)urban|built")).alias("urban"),
        fx.flag(fx.matches("Time", presets.TIME_PATTERN)).alias("time_ok"),
    )


@query(
    "strip_and_capitalize",
    "Accident_Index:i Vehicle_Reference:i sex:s manoeuvre:s",
    """SELECT Accident_Index, Vehicle_Reference, upper(substr(trim(Sex_of_Driver), 1, 1)) || lower(substr(trim(Sex_of_Driver), 2)) AS sex,
         upper(substr(trim(Vehicle_Manoeuvre), 1, 1)) || lower(substr(trim(Vehicle_Manoeuvre), 2)) AS manoeuvre FROM vehicles""",
    ["vehicles"],
)
def strip_and_capitalize(d):
    return d.vehicles.select(
        "Accident_Index", "Vehicle_Reference", fx.capitalized("Sex_of_Driver").alias("sex"), fx.capitalized("Vehicle_Manoeuvre").alias("manoeuvre")
    )


@query(
    "time_parts",
    "Accident_Index:i day:s hour:f year:f month:i name:s weekday:i season:s daypart:s",
    f"""SELECT Accident_Index, TRY_CAST(Date_Text AS DATE) AS day, h AS hour, year(TRY_CAST(Date_Text AS DATE)) AS year, month(Date) AS month,
         dayname(Date) AS name, isodow(Date) - 1 AS weekday,
         {case_map('month(Date)', {m: s for s, ms in (('Winter', (12, 1, 2)), ('Spring', (3, 4, 5)), ('Summer', (6, 7, 8)), ('Autumn', (9, 10, 11))) for m in ms})} AS season,
         CASE WHEN h BETWEEN 5 AND 9 THEN 'morning rush (5-10)' WHEN h BETWEEN 10 AND 14 THEN 'office hours (10-15)'
         WHEN h BETWEEN 15 AND 18 THEN 'afternoon rush (15-19)' WHEN h BETWEEN 19 AND 22 THEN 'evening (19-23)' ELSE 'night (23-5)' END AS daypart
       FROM (SELECT *, TRY_CAST(substr(Time, 1, 2) AS INT) AS h FROM accidents)""",
    ["accidents"],
)
def time_parts(d):
    hour = fx.hour_of_time("Time")
    day = fx.to_day("Date_Text")
    return d.accidents.select(
        "Accident_Index",
        day.alias("day"),
        hour.alias("hour"),
        F.year(day).alias("year"),
        F.month("Date").alias("month"),
        fx.day_name("Date").alias("name"),
        F.weekday("Date").alias("weekday"),
        fx.season(F.month("Date")).alias("season"),
        fx.daypart(hour).alias("daypart"),
    )


@query(
    "haversine_distance",
    "Accident_Index:i km:f",
    """SELECT Accident_Index, 2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians(51.5e0 - Latitude) / 2), 2)
         + cos(radians(Latitude)) * cos(radians(51.5e0)) * pow(sin(radians(-0.12e0 - Longitude) / 2), 2)))) AS km FROM accidents""",
    ["accidents"],
)
def haversine_distance(d):
    km = fx.haversine_km(F.col("Latitude"), F.col("Longitude"), F.lit(51.5), F.lit(-0.12))
    return d.accidents.select("Accident_Index", km.alias("km"))


@query(
    "numeric_functions",
    "Accident_Index:i Vehicle_Reference:i band:i clipped:f root:f cut:i rounded:f",
    """SELECT Accident_Index, Vehicle_Reference, CASE WHEN Engine_Capacity_CC > 4000 THEN 3 WHEN Engine_Capacity_CC > 2000 THEN 2
         WHEN Engine_Capacity_CC > 1400 THEN 1 WHEN Engine_Capacity_CC > 0 THEN 0 ELSE -1 END AS band,
         greatest(1000, least(3000, Engine_Capacity_CC)) + (0 * Engine_Capacity_CC) AS clipped,
         CASE WHEN Age_of_Vehicle >= 0 THEN sqrt(CAST(Age_of_Vehicle AS DOUBLE)) END AS root,
         CAST(trunc((coalesce(Age_of_Vehicle, 0) - 5) * 1.5e0) AS INT) AS cut, round(Age_of_Driver / 7e0, 3) AS rounded FROM vehicles""",
    ["vehicles"],
)
def numeric_functions(d):
    return d.vehicles.select(
        "Accident_Index",
        "Vehicle_Reference",
        fx.right_closed_bin("Engine_Capacity_CC", presets.ENGINE_EDGES).alias("band"),
        fx.clip(F.col("Engine_Capacity_CC").cast("double"), 1000.0, 3000.0).alias("clipped"),
        fx.safe_sqrt(F.col("Age_of_Vehicle").cast("double")).alias("root"),
        fx.truncated((F.coalesce("Age_of_Vehicle", F.lit(0)) - 5) * F.lit(1.5)).alias("cut"),
        F.round(F.col("Age_of_Driver") / F.lit(7.0), 3).alias("rounded"),
    )


@query(
    "age_band_midpoint",
    "Accident_Index:i Vehicle_Reference:i age:f",
    f"SELECT Accident_Index, Vehicle_Reference, {case_map('Age_Band_of_Driver', presets.AGE_MIDPOINTS, '30e0')} AS age FROM vehicles",
    ["vehicles"],
)
def age_band_midpoint(d):
    return d.vehicles.select(
        "Accident_Index", "Vehicle_Reference", fx.lookup("Age_Band_of_Driver", presets.AGE_MIDPOINTS, presets.DEFAULT_AGE).alias("age")
    )


@query(
    "label_codes_round_trip",
    "Accident_Index:i code:f label:s",
    f"""SELECT Accident_Index, code, {case_map('code', {0: 'Slight', 1: 'Serious', 2: 'Fatal'})} AS label
        FROM (SELECT Accident_Index, {case_map('Accident_Severity', presets.LABEL_CODES)} AS code FROM accidents)""",
    ["accidents"],
)
def label_codes_round_trip(d):
    code = fx.lookup("Accident_Severity", presets.LABEL_CODES)
    return d.accidents.select("Accident_Index", code.alias("code"), fx.lookup(code.cast("string"), presets.CODE_LABELS).alias("label"))


@query(
    "score_confidence",
    "row_id:i confidence:f fatal:f",
    "SELECT row_id, greatest(p_fatal, p_serious, p_slight) AS confidence, p_fatal AS fatal FROM scores",
    ["scores"],
)
def score_confidence(d):
    p = F.array("p_fatal", "p_serious", "p_slight")
    by_label = fx.probability_map(p, presets.LABELS)
    return d.scores.select("row_id", F.array_max(p).alias("confidence"), by_label["Fatal"].alias("fatal"))


@query(
    "json_encode",
    "Accident_Index:i doc:s",
    """SELECT Accident_Index, CAST(to_json({'severity': Accident_Severity, 'counts': {'vehicles': Number_of_Vehicles, 'casualties': Number_of_Casualties}}) AS VARCHAR) AS doc
       FROM accidents""",
    ["accidents"],
)
def json_encode(d):
    counts = F.struct(F.col("Number_of_Vehicles").alias("vehicles"), F.col("Number_of_Casualties").alias("casualties"))
    return d.accidents.select("Accident_Index", F.to_json(F.struct(F.col("Accident_Severity").alias("severity"), counts.alias("counts"))).alias("doc"))


@query(
    "null_safe_predicates",
    "Accident_Index:i not_dry:i member:i positive:i",
    """SELECT Accident_Index, CASE WHEN Road_Surface_Conditions IS DISTINCT FROM 'Dry' THEN 1 ELSE 0 END AS not_dry,
         CASE WHEN Day_of_Week IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS member,
         CASE WHEN Longitude > 0 THEN 1 ELSE 0 END AS positive FROM accidents""",
    ["accidents"],
)
def null_safe_predicates(d):
    return d.accidents.select(
        "Accident_Index",
        fx.differs_flag("Road_Surface_Conditions", "Dry").alias("not_dry"),
        fx.flag(fx.is_member("Day_of_Week", ["Saturday", "Sunday"])).alias("member"),
        fx.flag(F.col("Longitude") > 0).alias("positive"),
    )
