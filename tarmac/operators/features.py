"""Feature engineering. Row-local operators are plain expressions; group features use joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import presets
from tarmac.functions import scalar as fx
from tarmac.operators import skew
from tarmac.schema import col, guard
from pyspark.sql import types as T


def _code(df: DataFrame, source: str, target: str, codes: Mapping, default, on_missing: str = "skip", drop: bool = True) -> DataFrame:
    """Replace a category text by its code."""
    if not guard(df, [source], on_missing):
        return df
    out = df.withColumn(target, fx.lookup(source, codes, default))
    return out.drop(source) if drop and target != source else out


def encode_target(df: DataFrame, label: str = "Accident_Severity", codes: Mapping = presets.LABEL_CODES) -> DataFrame:
    """Label text to code; numeric labels pass; rows without a known label are dropped."""
    if label not in df.columns or isinstance(df.schema[label].dataType, T.NumericType):
        return df
    return df.withColumn(label, fx.lookup(label, codes).cast("long")).where(col(label).isNotNull())


def decode_labels(df: DataFrame, label: str, names: Mapping = presets.CODE_LABELS) -> DataFrame:
    """Codes to label texts; texts pass."""
    text = col(label).cast("string")
    return df.withColumn(label, F.coalesce(fx.lookup(text, names), text))


def unexpected_labels(df: DataFrame, label: str, expected: Sequence[str] = presets.LABELS) -> DataFrame:
    """Distinct labels that are not expected."""
    return df.select(col(label).cast("string").alias("label")).where(~fx.is_member("label", expected)).distinct()


def normalise_labels(df: DataFrame, label: str, expected: Sequence[str] = presets.LABELS) -> DataFrame:
    """``decode_labels`` that fails when an unknown label is left."""
    out = decode_labels(df, label)
    unknown = [r["label"] for r in unexpected_labels(out, label, expected).limit(20).collect()]
    if unknown:
        raise ValueError(f"unexpected labels {unknown}, expected {list(expected)}")
    return out


def temporal_features(df: DataFrame, date: str = "Date", on_missing: str = "skip") -> DataFrame:
    """hour_of_day, day_of_week (Monday 0), is_weekend, month, season."""
    if not guard(df, [date], on_missing):
        return df
    when = col(date) if not isinstance(df.schema[date].dataType, T.StringType) else F.try_to_timestamp(col(date))
    return df.withColumns(
        {
            "hour_of_day": F.hour(when.cast("timestamp")),
            "day_of_week": F.weekday(when),
            "is_weekend": fx.flag(F.weekday(when) >= 5),
            "month": F.month(when),
            "season": fx.season(F.month(when)),
        }
    )


def lighting_features(df: DataFrame, source: str = "Light_Conditions") -> DataFrame:
    """is_dark; 0 for all rows when the source column is absent."""
    if source not in df.columns:
        return df.withColumn("is_dark", F.lit(0))
    return df.withColumn("is_dark", fx.flag(fx.contains_any(source, ["Darkness", "darkness"]))).drop(source)


def road_type_code(df: DataFrame, source: str = "Road_Type", target: str = "Road_Type") -> DataFrame:
    return _code(df, source, target, presets.ROAD_TYPE_CODES, 1, drop=False)


def road_surface_flag(df: DataFrame, source: str = "Road_Surface_Conditions", on_missing: str = "skip") -> DataFrame:
    """is_wet_road: anything but Dry, null included."""
    if not guard(df, [source], on_missing):
        return df
    return df.withColumn("is_wet_road", fx.differs_flag(source, "Dry")).drop(source)


def weather_text_flag(
    df: DataFrame, source: str = "Weather_Conditions", target: str = "is_adverse_weather_text", on_missing: str = "skip"
) -> DataFrame:
    """1 for any weather text but fine. Named apart from the measured flag, so both can be kept."""
    if not guard(df, [source], on_missing):
        return df
    return df.withColumn(target, fx.differs_flag(source, "Fine no high winds")).drop(source)


def urban_flag(
    df: DataFrame, source: str = "Urban_or_Rural_Area", variant: str = "pattern", on_missing: str = "skip"
) -> DataFrame:
    """is_urban by pattern, or (``exact``) for the values Urban and Unallocated."""
    if not guard(df, [source], on_missing):
        return df
    if variant == "exact":
        test = fx.is_member(source, ["Urban", "Unallocated"])
    elif variant == "pattern":
        test = fx.matches(source, "(?i)urban|built")
    else:
        raise ValueError("variant must be 'pattern' or 'exact'")
    return df.withColumn("is_urban", fx.flag(test)).drop(source)


def weather_measure_flag(df: DataFrame, target: str = "is_adverse_weather") -> DataFrame:
    """Rain, snow or at least six oktas of cloud, over the columns that are present."""
    tests = {
        "prcp": lambda c: c > 0,
        "snwd": lambda c: c > 0,
        "cldc": lambda c: c >= 6,
    }
    adverse = F.lit(False)
    for name, test in tests.items():
        if name in df.columns:
            adverse = adverse | F.coalesce(test(col(name)), F.lit(False))
    return df.withColumn(target, fx.flag(adverse))


def road_risk_score(df: DataFrame, speed: str = "Speed_limit", road: str = "Road_Type", on_missing: str = "skip") -> DataFrame:
    """Speed risk times the multiplier of the road type text, truncated.

    Needs ``road`` as text: run it before the type is encoded.
    """
    if not guard(df, [speed, road], on_missing):
        return df
    risk = fx.lookup(F.coalesce(fx.to_number(speed), F.lit(30.0)).cast("int"), presets.SPEED_RISK, 3)
    factor = fx.lookup(F.coalesce(col(road), F.lit("Single carriageway")), presets.ROAD_RISK_MULTIPLIERS, 1.0)
    return df.withColumn("road_risk_score", fx.truncated(risk * factor))


def adverse_dark(df: DataFrame) -> DataFrame:
    if not guard(df, ["is_adverse_weather", "is_dark"], "skip"):
        return df.withColumn("adverse_dark", F.lit(0))
    return df.withColumn("adverse_dark", (F.col("is_adverse_weather") * F.col("is_dark")).cast("int"))


def precip_single_carriageway(df: DataFrame, road: str = "Road_Type") -> DataFrame:
    if not guard(df, ["prcp", road], "skip"):
        return df.withColumn("precip_single_carriageway", F.lit(0))
    test = (F.col("prcp") > 1.0) & (col(road) == "Single carriageway")
    return df.withColumn("precip_single_carriageway", fx.flag(test))


def temp_road_risk(df: DataFrame) -> DataFrame:
    """Road risk, half as much again below 5 degrees (no reading counts as 15)."""
    if "road_risk_score" not in df.columns:
        return df.withColumn("temp_road_risk", F.lit(0.0))
    risk = F.col("road_risk_score").cast("double")
    if "temp" not in df.columns:
        return df.withColumn("temp_road_risk", risk)
    return df.withColumn("temp_road_risk", F.when(F.col("temp") < 5, risk * 1.5).otherwise(risk))


def seasonal_risk(df: DataFrame) -> DataFrame:
    if not guard(df, ["temp", "month"], "skip"):
        return df.withColumn("seasonal_risk", F.lit(0))
    return df.withColumn("seasonal_risk", fx.flag(F.col("month").isin(12, 1, 2) & (F.col("temp") < 5)))


def weather_composites(df: DataFrame, road: str = "Road_Type") -> DataFrame:
    return seasonal_risk(temp_road_risk(precip_single_carriageway(adverse_dark(df), road)))


def vehicle_features(
    df: DataFrame,
    key: str = "Accident_Index",
    age: str = "Age_of_Driver",
    kind: str = "Vehicle_Type",
    vehicle_age: str = "Age_of_Vehicle",
    **skew_options,
) -> DataFrame:
    """Per accident: oldest and youngest driver, motorcycles, mean vehicle age.

    ``kind`` must still be text. One aggregate serves all of them.
    """
    aggs = []
    if age in df.columns:
        driver = fx.to_number(age)
        aggs += [F.max(driver).alias("max_driver_age"), F.min(driver).alias("min_driver_age")]
    if kind in df.columns:
        aggs.append(F.sum(fx.flag(fx.contains_any(kind, ["Motorcycle"]))).alias("num_motorcycles"))
    if vehicle_age in df.columns:
        aggs.append(F.avg(fx.to_number(vehicle_age)).alias("avg_vehicle_age"))
    return skew.attach_group_stats(df, [key], aggs, **skew_options) if aggs else df


def vehicle_attributes(df: DataFrame) -> DataFrame:
    """Vehicle type, impact point, petrol, towing and engine band codes, each if present."""
    out = _code(df, "Vehicle_Type", "Vehicle_Type", presets.VEHICLE_TYPE_CODES, 4)
    out = _code(out, "X1st_Point_of_Impact", "X1st_Point_of_Impact", presets.IMPACT_CODES, 0)
    if "Propulsion_Code" in out.columns:
        out = out.withColumn("is_petrol", fx.flag(F.col("Propulsion_Code") == "Petrol")).drop("Propulsion_Code")
    out = _code(out, "Towing_and_Articulation", "is_towing", presets.TOWING_CODES, 0)
    if "Engine_Capacity_CC" in out.columns:
        out = out.withColumn("engine_size_category", fx.right_closed_bin("Engine_Capacity_CC", presets.ENGINE_EDGES))
    return out


def driver_features(df: DataFrame) -> DataFrame:
    out = _code(df, "Age_Band_of_Driver", "age", presets.AGE_MIDPOINTS, presets.DEFAULT_AGE)
    out = _code(out, "Sex_of_Driver", "is_male", presets.SEX_FLAG, 1)
    return _code(out, "Driver_Home_Area_Type", "driver_area_encoded", presets.HOME_AREA_CODES, -1)


def manoeuvre_code(df: DataFrame, source: str = "Vehicle_Manoeuvre") -> DataFrame:
    codes = {text: presets.MANOEUVRE_GROUP_CODES[group] for text, group in presets.MANOEUVRE_GROUPS.items()}
    return _code(df, source, "manoeuvre_encoded", codes, -1)


def junction_codes(df: DataFrame) -> DataFrame:
    out = _code(df, "Junction_Location", "Junction_Location", presets.JUNCTION_LOCATION_CODES, -1)
    out = _code(out, "Junction_Control", "junction_control_encoded", presets.JUNCTION_CONTROL_CODES, -1)
    return _code(out, "Junction_Detail", "junction_detail_encoded", presets.JUNCTION_DETAIL_CODES, -1)


def journey_purpose_code(df: DataFrame) -> DataFrame:
    return _code(df, "Journey_Purpose_of_Driver", "journey_purpose_encoded", presets.JOURNEY_CODES, -1)


def road_class_code(df: DataFrame, source: str = "X1st_Road_Class") -> DataFrame:
    return _code(df, source, source, presets.ROAD_CLASS_CODES, 5)


def interaction_features(df: DataFrame, speed: str = "Speed_limit", road: str = "Road_Type") -> DataFrame:
    """speed_x_road_risk (text road type), wet_road_speed, young_driver_night."""
    out = df
    if guard(df, [speed, road], "skip"):
        factor = fx.lookup(F.coalesce(col(road), F.lit("Single carriageway")), presets.ROAD_SPEED_MULTIPLIERS, 1.0)
        out = out.withColumn("speed_x_road_risk", fx.truncated(F.coalesce(fx.to_number(speed), F.lit(0.0)) * factor))
    if guard(df, ["is_wet_road", speed], "skip"):
        out = out.withColumn("wet_road_speed", fx.flag((F.col("is_wet_road") == 1) & (col(speed) >= 60)))
    if guard(df, ["age", "is_dark"], "skip"):
        out = out.withColumn("young_driver_night", fx.flag((F.col("age") <= 25) & (F.col("is_dark") == 1)))
    return out


def rush_hour_flag(df: DataFrame, time: str = "Time", on_missing: str = "skip") -> DataFrame:
    if not guard(df, [time], on_missing):
        return df
    hour = fx.hour_of_time(time)
    return df.withColumn("is_rush_hour", fx.flag(hour.between(7, 9) | hour.between(16, 19)))


def exact_value_flags(df: DataFrame, day: str = "Day_of_Week", light: str = "Light_Conditions", weather: str = "Weather_Conditions") -> DataFrame:
    """Flags by exact value: weekend from the day name, daylight, weather other than fine."""
    out = df
    if day in df.columns:
        out = out.withColumn("is_weekend", fx.flag(fx.is_member(day, ["Saturday", "Sunday"])))
    if light in df.columns:
        out = out.withColumn("is_daylight", fx.flag(col(light) == "Daylight"))
    if weather in df.columns:
        out = out.withColumn("is_ubnormal_weather", fx.differs_flag(weather, "Fine no high winds"))
    return out


def speed_x_road_code(df: DataFrame, speed: str = "Speed_limit", road_code: str = "Road_Type") -> DataFrame:
    """Speed times the encoded road type."""
    return df.withColumn("speed_x_road_code", fx.to_number(speed) * fx.to_number(road_code))
