"""Feature-engineering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import presets
from tarmac.catalog.integration import WITH_WEATHER, gb_stations, with_weather
from tarmac.catalog.registry import case_map, query
from tarmac.operators import clean, groupstats, joins
from tarmac.operators import features as fe
from tarmac.plans import flows
from tarmac.session import new_path
from tarmac.sources import snapshots

_DARK = "CASE WHEN contains(coalesce(Light_Conditions, ''), 'Darkness') THEN 1 ELSE 0 END"
_RISK = f"""CAST(floor({case_map('coalesce(Speed_limit, 30)', presets.SPEED_RISK, '3')}
  * {case_map("coalesce(Road_Type, 'Single carriageway')", presets.ROAD_RISK_MULTIPLIERS, '1e0')}) AS INT)"""
_ADVERSE = "CASE WHEN coalesce(prcp > 0, false) OR coalesce(snwd > 0, false) OR coalesce(cldc >= 6, false) THEN 1 ELSE 0 END"


@query(
    "encode_target",
    "Accident_Index:i Accident_Severity:i",
    f"SELECT * FROM (SELECT Accident_Index, {case_map('Accident_Severity', presets.LABEL_CODES)} AS Accident_Severity FROM accidents) WHERE Accident_Severity IS NOT NULL",
    ["accidents"],
)
def encode_target(d):
    return fe.encode_target(d.accidents)


_SEASON = case_map("month(ts)", {m: s for s, ms in (("Winter", (12, 1, 2)), ("Spring", (3, 4, 5)), ("Summer", (6, 7, 8)), ("Autumn", (9, 10, 11))) for m in ms})


@query(
    "temporal_features",
    "event_id:i hour_of_day:i day_of_week:i is_weekend:i month:i season:s",
    f"""SELECT event_id, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
          month(ts) AS month, {_SEASON} AS season FROM events""",
)
def temporal_features(d):
    return fe.temporal_features(d.events, "ts")


@query(
    "temporal_features_from_text",
    "Accident_Index:i day_of_week:f is_weekend:i month:f season:s",
    f"""SELECT Accident_Index, isodow(ts) - 1 AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, month(ts) AS month, {_SEASON} AS season
        FROM (SELECT Accident_Index, TRY_CAST(Date_Text AS DATE) AS ts FROM accidents)""",
    ["accidents"],
)
def temporal_features_from_text(d):
    return fe.temporal_features(d.accidents, "Date_Text")


@query("lighting_features", "Accident_Index:i is_dark:i", f"SELECT Accident_Index, {_DARK} AS is_dark FROM accidents", ["accidents"])
def lighting_features(d):
    return fe.lighting_features(d.accidents)


@query(
    "road_type_code",
    "Accident_Index:i Road_Type:i",
    f"SELECT Accident_Index, {case_map('Road_Type', presets.ROAD_TYPE_CODES, '1')} AS Road_Type FROM accidents",
    ["accidents"],
)
def road_type_code(d):
    return fe.road_type_code(d.accidents)


@query(
    "road_surface_flag",
    "Accident_Index:i is_wet_road:i",
    "SELECT Accident_Index, CASE WHEN Road_Surface_Conditions IS DISTINCT FROM 'Dry' THEN 1 ELSE 0 END AS is_wet_road FROM accidents",
    ["accidents"],
)
def road_surface_flag(d):
    return fe.road_surface_flag(d.accidents)


@query(
    "weather_text_flag",
    "Accident_Index:i is_adverse_weather:i",
    "SELECT Accident_Index, CASE WHEN Weather_Conditions IS DISTINCT FROM 'Fine no high winds' THEN 1 ELSE 0 END AS is_adverse_weather FROM accidents",
    ["accidents"],
)
def weather_text_flag(d):
    return fe.weather_text_flag(d.accidents, target="is_adverse_weather")


@query(
    "urban_flag",
    "Accident_Index:i is_urban:i",
    "SELECT Accident_Index, CASE WHEN regexp_matches(lower(Urban_or_Rural_Area), 'urban|built') THEN 1 ELSE 0 END AS is_urban FROM accidents",
    ["accidents"],
)
def urban_flag(d):
    return fe.urban_flag(d.accidents)


@query(
    "urban_flag_exact",
    "Accident_Index:i is_urban:i",
    "SELECT Accident_Index, CASE WHEN Urban_or_Rural_Area IN ('Urban', 'Unallocated') THEN 1 ELSE 0 END AS is_urban FROM accidents",
    ["accidents"],
)
def urban_flag_exact(d):
    return fe.urban_flag(d.accidents, variant="exact")


@query(
    "weather_measure_flag",
    "station_id:i time:s is_adverse_weather:i",
    f"SELECT station_id, time, {_ADVERSE} AS is_adverse_weather FROM weather",
    ["weather"],
)
def weather_measure_flag(d):
    return fe.weather_measure_flag(d.weather)


@query("road_risk_score", "Accident_Index:i road_risk_score:i", f"SELECT Accident_Index, {_RISK} AS road_risk_score FROM accidents", ["accidents"])
def road_risk_score(d):
    return fe.road_risk_score(d.accidents)


@query(
    "weather_composites",
    "Accident_Index:i adverse_dark:i precip_single_carriageway:i temp_road_risk:f seasonal_risk:i",
    f"""SELECT Accident_Index, {_ADVERSE} * {_DARK} AS adverse_dark,
          CASE WHEN prcp > 1 AND Road_Type = 'Single carriageway' THEN 1 ELSE 0 END AS precip_single_carriageway,
          {_RISK} * CASE WHEN temp < 5 THEN 1.5e0 ELSE 1e0 END AS temp_road_risk,
          CASE WHEN month(Date) IN (12, 1, 2) AND temp < 5 THEN 1 ELSE 0 END AS seasonal_risk FROM ({WITH_WEATHER})""",
    ["accidents", "stations", "weather"],
)
def weather_composites(d):
    out = fe.temporal_features(with_weather(d))
    out = fe.weather_measure_flag(fe.lighting_features(out))
    return fe.weather_composites(fe.road_risk_score(out))


_ATTRIBUTES = f"""{case_map('Vehicle_Type', presets.VEHICLE_TYPE_CODES, '4')} AS Vehicle_Type,
  {case_map('X1st_Point_of_Impact', presets.IMPACT_CODES, '0')} AS X1st_Point_of_Impact,
  CASE WHEN Propulsion_Code = 'Petrol' THEN 1 ELSE 0 END AS is_petrol,
  {case_map('Towing_and_Articulation', presets.TOWING_CODES, '0')} AS is_towing,
  CASE WHEN Engine_Capacity_CC > 4000 THEN 3 WHEN Engine_Capacity_CC > 2000 THEN 2 WHEN Engine_Capacity_CC > 1400 THEN 1
       WHEN Engine_Capacity_CC > 0 THEN 0 ELSE -1 END AS engine_size_category"""


@query(
    "vehicle_attributes",
    "Accident_Index:i Vehicle_Reference:i Vehicle_Type:i X1st_Point_of_Impact:i is_petrol:i is_towing:i engine_size_category:i",
    f"SELECT Accident_Index, Vehicle_Reference, {_ATTRIBUTES} FROM vehicles",
    ["vehicles"],
)
def vehicle_attributes(d):
    return fe.vehicle_attributes(d.vehicles)


@query(
    "driver_features",
    "Accident_Index:i Vehicle_Reference:i age:f is_male:i driver_area_encoded:i",
    f"""SELECT Accident_Index, Vehicle_Reference, {case_map('Age_Band_of_Driver', presets.AGE_MIDPOINTS, '30e0')} AS age,
          {case_map('Sex_of_Driver', presets.SEX_FLAG, '1')} AS is_male, {case_map('Driver_Home_Area_Type', presets.HOME_AREA_CODES, '-1')} AS driver_area_encoded
        FROM vehicles""",
    ["vehicles"],
)
def driver_features(d):
    return fe.driver_features(d.vehicles)


_MANOEUVRE = {t: presets.MANOEUVRE_GROUP_CODES[g] for t, g in presets.MANOEUVRE_GROUPS.items()}


@query(
    "manoeuvre_code",
    "Accident_Index:i Vehicle_Reference:i manoeuvre_encoded:i",
    f"SELECT Accident_Index, Vehicle_Reference, {case_map('Vehicle_Manoeuvre', _MANOEUVRE, '-1')} AS manoeuvre_encoded FROM vehicles",
    ["vehicles"],
)
def manoeuvre_code(d):
    return fe.manoeuvre_code(d.vehicles)


@query(
    "junction_codes",
    "Accident_Index:i junction_control_encoded:i junction_detail_encoded:i",
    f"""SELECT Accident_Index, {case_map('Junction_Control', presets.JUNCTION_CONTROL_CODES, '-1')} AS junction_control_encoded,
          {case_map('Junction_Detail', presets.JUNCTION_DETAIL_CODES, '-1')} AS junction_detail_encoded FROM accidents""",
    ["accidents"],
)
def junction_codes(d):
    return fe.junction_codes(d.accidents)


@query(
    "junction_location_code",
    "Accident_Index:i Vehicle_Reference:i Junction_Location:i",
    f"SELECT Accident_Index, Vehicle_Reference, {case_map('Junction_Location', presets.JUNCTION_LOCATION_CODES, '-1')} AS Junction_Location FROM vehicles",
    ["vehicles"],
)
def junction_location_code(d):
    return fe.junction_codes(d.vehicles)


@query(
    "journey_purpose_code",
    "Accident_Index:i Vehicle_Reference:i journey_purpose_encoded:i",
    f"SELECT Accident_Index, Vehicle_Reference, {case_map('Journey_Purpose_of_Driver', presets.JOURNEY_CODES, '-1')} AS journey_purpose_encoded FROM vehicles",
    ["vehicles"],
)
def journey_purpose_code(d):
    return fe.journey_purpose_code(d.vehicles)


_W = case_map("Accident_Severity", presets.SEVERITY_WEIGHTS)
_ROWS = "(SELECT * FROM accidents_admin LEFT JOIN (SELECT Accident_Index, Vehicle_Reference, make FROM vehicles) USING (Accident_Index))"


def _stat(column, name):
    return f"{name} AS (SELECT {column} AS k, avg({_W}) AS m, count(*) AS n FROM base WHERE {column} IS NOT NULL GROUP BY 1)"


_ADMIN_SQL = f"""WITH base AS {_ROWS}, {_stat('make', 'gm')}, {_stat('Local_Authority_District', 'gd')}, {_stat('Local_Authority_Highway', 'gh')}
  SELECT Accident_Index, Vehicle_Reference, coalesce(gm.m, 1e0) AS make, coalesce(gd.m, 1e0) AS district_severity_rate,
    coalesce(gd.n, (SELECT median(n) FROM gd)) AS district_accident_volume, coalesce(gh.m, 1e0) AS highway_severity_rate,
    coalesce(gh.n, (SELECT median(n) FROM gh)) AS highway_accident_volume, {case_map('X1st_Road_Class', presets.ROAD_CLASS_CODES, '5')} AS X1st_Road_Class
  FROM base LEFT JOIN gm ON make = gm.k LEFT JOIN gd ON Local_Authority_District = gd.k LEFT JOIN gh ON Local_Authority_Highway = gh.k"""
_ADMIN_SPEC = (
    "Accident_Index:i Vehicle_Reference:f make:f district_severity_rate:f district_accident_volume:f "
    "highway_severity_rate:f highway_accident_volume:f X1st_Road_Class:i"
)


def _admin_rows(d):
    return joins.merge_details(d.accidents_admin, d.vehicles.select("Accident_Index", "Vehicle_Reference", "make"))


@query("admin_features", _ADMIN_SPEC, _ADMIN_SQL, ["accidents_admin", "vehicles"])
def admin_features(d):
    return groupstats.admin_features(_admin_rows(d))


@query("admin_features_many_levels", _ADMIN_SPEC, _ADMIN_SQL, ["accidents_admin", "vehicles"])
def admin_features_many_levels(d):
    # No level table counts as small here, so the encoding joins on shuffled keys.
    rows = _admin_rows(d)
    columns = ["make", "Local_Authority_District", "Local_Authority_Highway"]
    return groupstats.admin_features(rows, groupstats.fit_group_encoding(rows, columns, max_rows=0))


@query(
    "target_mean_encoding_codes",
    "make:s mean:f volume:i",
    """SELECT make, avg(CASE Accident_Severity WHEN 'Slight' THEN 0e0 WHEN 'Serious' THEN 1e0 WHEN 'Fatal' THEN 2e0 END) AS mean, count(*) AS volume
       FROM accidents JOIN vehicles USING (Accident_Index) WHERE make IS NOT NULL GROUP BY make""",
    ["accidents", "vehicles"],
)
def target_mean_encoding_codes(d):
    rows = d.accidents.select("Accident_Index", "Accident_Severity").join(d.vehicles.select("Accident_Index", "make"), "Accident_Index")
    encoding = groupstats.fit_group_encoding(rows, ["make"], weights=presets.SEVERITY_CODE_WEIGHTS)
    return encoding.levels.select(F.col("level").alias("make"), "mean", "volume")


@query(
    "group_volume",
    "Accident_Index:i volume:f",
    """WITH g AS (SELECT Local_Authority_Highway AS k, count(*) AS n FROM accidents_admin WHERE Local_Authority_Highway IS NOT NULL GROUP BY 1)
       SELECT Accident_Index, coalesce(n, (SELECT median(n) FROM g)) AS volume FROM accidents_admin LEFT JOIN g ON Local_Authority_Highway = k""",
    ["accidents_admin"],
)
def group_volume(d):
    encoding = groupstats.fit_group_encoding(d.accidents_admin, ["Local_Authority_Highway"])
    return encoding.attach(d.accidents_admin, "Local_Authority_Highway", None, "volume")


@query(
    "interaction_features",
    "Accident_Index:i Vehicle_Reference:i speed_x_road_risk:i wet_road_speed:i young_driver_night:i",
    f"""SELECT Accident_Index, Vehicle_Reference,
          CAST(floor(coalesce(Speed_limit, 0) * {case_map("coalesce(Road_Type, 'Single carriageway')", presets.ROAD_SPEED_MULTIPLIERS, '1e0')}) AS INT) AS speed_x_road_risk,
          CASE WHEN Road_Surface_Conditions IS DISTINCT FROM 'Dry' AND Speed_limit >= 60 THEN 1 ELSE 0 END AS wet_road_speed,
          CASE WHEN {case_map('Age_Band_of_Driver', presets.AGE_MIDPOINTS, '30e0')} <= 25 AND {_DARK} = 1 THEN 1 ELSE 0 END AS young_driver_night
        FROM accidents JOIN vehicles USING (Accident_Index)""",
    ["accidents", "vehicles"],
)
def interaction_features(d):
    rows = d.accidents.select("Accident_Index", "Speed_limit", "Road_Type", "Light_Conditions", "Road_Surface_Conditions").join(
        d.vehicles.select("Accident_Index", "Vehicle_Reference", "Age_Band_of_Driver"), "Accident_Index"
    )
    return fe.interaction_features(fe.driver_features(fe.road_surface_flag(fe.lighting_features(rows))))


@query(
    "rush_hour_flag",
    "Accident_Index:i is_rush_hour:i",
    "SELECT Accident_Index, CASE WHEN h BETWEEN 7 AND 9 OR h BETWEEN 16 AND 19 THEN 1 ELSE 0 END AS is_rush_hour FROM (SELECT *, TRY_CAST(substr(Time, 1, 2) AS INT) AS h FROM accidents)",
    ["accidents"],
)
def rush_hour_flag(d):
    return fe.rush_hour_flag(d.accidents)


@query(
    "exact_value_flags",
    "Accident_Index:i is_weekend:i is_daylight:i is_ubnormal_weather:i",
    """SELECT Accident_Index, CASE WHEN Day_of_Week IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN Light_Conditions = 'Daylight' THEN 1 ELSE 0 END AS is_daylight,
         CASE WHEN Weather_Conditions IS DISTINCT FROM 'Fine no high winds' THEN 1 ELSE 0 END AS is_ubnormal_weather FROM accidents""",
    ["accidents"],
)
def exact_value_flags(d):
    return fe.exact_value_flags(d.accidents)


@query(
    "speed_x_road_code",
    "Accident_Index:i speed_x_road_code:f",
    f"SELECT Accident_Index, Speed_limit * {case_map('Road_Type', presets.ROAD_TYPE_CODES, '1')} AS speed_x_road_code FROM accidents",
    ["accidents"],
)
def speed_x_road_code(d):
    return fe.speed_x_road_code(fe.road_type_code(d.accidents))


@query(
    "engineered_features",
    "Accident_Index:i Vehicle_Reference:f is_dark:i is_wet_road:i is_urban:i road_risk_score:i adverse_dark:i temp_road_risk:f num_motorcycles:f "
    "Vehicle_Type:i engine_size_category:i age:f is_male:i manoeuvre_encoded:i journey_purpose_encoded:i junction_control_encoded:i "
    "district_severity_rate:f highway_accident_volume:f X1st_Road_Class:i speed_x_road_risk:i Road_Type:i",
    f"""WITH joined AS (SELECT w.*, aa.Local_Authority_District, aa.Local_Authority_Highway FROM ({WITH_WEATHER}) AS w JOIN accidents_admin AS aa USING (Accident_Index)),
      base AS (SELECT * FROM joined LEFT JOIN (SELECT * EXCLUDE (Year) FROM vehicles) USING (Accident_Index)),
      {_stat('Local_Authority_District', 'gd')}, {_stat('Local_Authority_Highway', 'gh')}
      SELECT Accident_Index, Vehicle_Reference, {_DARK} AS is_dark, CASE WHEN Road_Surface_Conditions IS DISTINCT FROM 'Dry' THEN 1 ELSE 0 END AS is_wet_road,
        CASE WHEN regexp_matches(lower(Urban_or_Rural_Area), 'urban|built') THEN 1 ELSE 0 END AS is_urban, {_RISK} AS road_risk_score,
        {_ADVERSE} * {_DARK} AS adverse_dark, {_RISK} * CASE WHEN temp < 5 THEN 1.5e0 ELSE 1e0 END AS temp_road_risk,
        sum(CASE WHEN contains(coalesce(Vehicle_Type, ''), 'Motorcycle') THEN 1 ELSE 0 END) OVER (PARTITION BY Accident_Index) AS num_motorcycles,
        {_ATTRIBUTES}, {case_map('Age_Band_of_Driver', presets.AGE_MIDPOINTS, '30e0')} AS age, {case_map('Sex_of_Driver', presets.SEX_FLAG, '1')} AS is_male,
        {case_map('Vehicle_Manoeuvre', _MANOEUVRE, '-1')} AS manoeuvre_encoded, {case_map('Journey_Purpose_of_Driver', presets.JOURNEY_CODES, '-1')} AS journey_purpose_encoded,
        {case_map('Junction_Control', presets.JUNCTION_CONTROL_CODES, '-1')} AS junction_control_encoded, coalesce(gd.m, 1e0) AS district_severity_rate,
        coalesce(gh.n, (SELECT median(n) FROM gh)) AS highway_accident_volume, {case_map('X1st_Road_Class', presets.ROAD_CLASS_CODES, '5')} AS X1st_Road_Class,
        CAST(floor(coalesce(Speed_limit, 0) * {case_map("coalesce(Road_Type, 'Single carriageway')", presets.ROAD_SPEED_MULTIPLIERS, '1e0')}) AS INT) AS speed_x_road_risk,
        {case_map('Road_Type', presets.ROAD_TYPE_CODES, '1')} AS Road_Type
      FROM base LEFT JOIN gd ON Local_Authority_District = gd.k LEFT JOIN gh ON Local_Authority_Highway = gh.k""",
    ["accidents_admin", "vehicles", "stations", "weather"],
)
def engineered_features(d):
    merged = joins.integrate(d.accidents_admin, d.vehicles, gb_stations(d), d.weather)
    return flows.engineer(snapshots.write_snapshot(merged, new_path(d.spark, "merged")))


@query(
    "cleaned_and_engineered",
    "Accident_Index:i Vehicle_Reference:f is_dark:i road_risk_score:i age:f is_male:i Road_Type:i",
    f"""SELECT DISTINCT Accident_Index, Vehicle_Reference, {_DARK} AS is_dark, {_RISK} AS road_risk_score,
          {case_map(r"CASE WHEN regexp_matches(Age_Band_of_Driver, '^\d+\s*-\s*\d+$|^Over 75$') THEN Age_Band_of_Driver END", presets.AGE_MIDPOINTS, '30e0')} AS age,
          CASE WHEN Sex_of_Driver IN ('Female', 'F', '2') THEN 0 ELSE 1 END AS is_male, {case_map('Road_Type', presets.ROAD_TYPE_CODES, '1')} AS Road_Type
        FROM accidents JOIN vehicles USING (Accident_Index)
        WHERE Speed_limit IN (20, 30, 40, 50, 60, 70) AND Latitude IS NOT NULL AND Longitude IS NOT NULL""",
    ["accidents", "vehicles"],
)
def cleaned_and_engineered(d):
    rows = joins.merge_details(d.accidents, d.vehicles, how="inner")
    out = flows.engineer(clean.clean(rows))
    return out.select("Accident_Index", "Vehicle_Reference", "is_dark", "road_risk_score", "age", "is_male", "Road_Type").distinct()
