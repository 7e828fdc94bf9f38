"""Projections, filters, predicates, set operations and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import presets
from tarmac.catalog.registry import query
from tarmac.functions import scalar as fx
from tarmac.operators import clean, features, impute, profile, rollups
from tarmac.schema import select_numeric
from tarmac.sources import domain

_SPEEDS = "(20, 30, 40, 50, 60, 70)"


@query(
    "drop_sparse_columns",
    "columns_left:i has_hazards:i has_note:i rows:i",
    """SELECT 26 - (CASE WHEN h >= 0.97e0 THEN 1 ELSE 0 END) - 1 AS columns_left, CASE WHEN h >= 0.97e0 THEN 0 ELSE 1 END AS has_hazards,
         CASE WHEN s >= 0.97e0 THEN 0 ELSE 1 END AS has_note, n AS rows
       FROM (SELECT avg(CASE WHEN Carriageway_Hazards IS NULL THEN 1e0 ELSE 0e0 END) AS h,
               avg(CASE WHEN Site_Note IS NULL THEN 1e0 ELSE 0e0 END) AS s, count(*) AS n FROM accidents)""",
    ["accidents"],
)
def drop_sparse_columns(d):
    out = clean.drop_sparse_columns(d.accidents, named=["X2nd_Road_Class"])
    return out.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(out.columns)).alias("columns_left"),
        F.lit(int("Carriageway_Hazards" in out.columns)).alias("has_hazards"),
        F.lit(int("Site_Note" in out.columns)).alias("has_note"),
    )


@query(
    "drop_columns_over_missing",
    "has_snwd:i has_kept:i has_note:i rows:i",
    """SELECT CASE WHEN share > 0.5e0 THEN 0 ELSE 1 END AS has_snwd, 1 AS has_kept,
         (SELECT CASE WHEN avg(CASE WHEN Site_Note IS NULL THEN 1e0 ELSE 0e0 END) > 0.5e0 THEN 0 ELSE 1 END FROM accidents) AS has_note, n AS rows
       FROM (SELECT avg(CASE WHEN snwd IS NULL THEN 1e0 ELSE 0e0 END) AS share, count(*) AS n FROM weather)""",
    ["weather", "accidents"],
)
def drop_columns_over_missing(d):
    bare = clean.drop_columns_over_missing(d.weather, 50.0, keep=[])
    kept = clean.drop_columns_over_missing(d.weather, 50.0)
    other = clean.drop_columns_over_missing(d.accidents, 50.0)
    return bare.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(int("snwd" in bare.columns)).alias("has_snwd"),
        F.lit(int("snwd" in kept.columns)).alias("has_kept"),
        F.lit(int("Site_Note" in other.columns)).alias("has_note"),
    )


@query(
    "filter_valid_speed",
    "Accident_Index:i Speed_limit:i",
    f"SELECT Accident_Index, Speed_limit FROM accidents WHERE Speed_limit IN {_SPEEDS}",
    ["accidents"],
)
def filter_valid_speed(d):
    return clean.filter_valid_set(d.accidents)


@query(
    "require_non_null",
    "Accident_Index:i Latitude:f Longitude:f Speed_limit:i",
    """SELECT Accident_Index, Latitude, Longitude, Speed_limit FROM accidents
       WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL AND Speed_limit IS NOT NULL AND Accident_Index IS NOT NULL""",
    ["accidents"],
)
def require_non_null(d):
    return clean.require_non_null(d.accidents)


@query(
    "drop_any_null",
    "Accident_Index:i",
    "SELECT Accident_Index FROM vehicles WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in domain.VEHICLE_COLUMNS),
    ["vehicles"],
)
def drop_any_null(d):
    return clean.drop_any_null(d.vehicles)


@query(
    "drop_unwanted_columns",
    "rows:i columns_left:i",
    "SELECT count(*) AS rows, 26 - 5 AS columns_left FROM accidents",
    ["accidents"],
)
def drop_unwanted_columns(d):
    out = clean.drop_columns(d.accidents, presets.UNWANTED_COLUMNS + presets.UNWANTED_SPARSE_COLUMNS)
    return out.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns_left", F.lit(len(out.columns)))


@query(
    "first_columns",
    "Accident_Index:i Reporter_Key:i Accident_Severity:s",
    "SELECT Accident_Index, Reporter_Key, Accident_Severity FROM accidents",
    ["accidents"],
)
def first_columns(d):
    return clean.first_columns(d.accidents, 3)


@query(
    "fix_day_of_week",
    "Accident_Index:i Day_of_Week:s",
    "SELECT Accident_Index, dayname(Date) AS Day_of_Week FROM accidents",
    ["accidents"],
)
def fix_day_of_week(d):
    return clean.fix_day_of_week(d.accidents)


@query(
    "age_bands_matching",
    "Accident_Index:i Vehicle_Reference:i loose:s strict:s",
    r"""SELECT Accident_Index, Vehicle_Reference,
          CASE WHEN regexp_matches(Age_Band_of_Driver, '^\d+\s*-\s*\d+$|^Over 75$') THEN Age_Band_of_Driver END AS loose,
          CASE WHEN regexp_matches(Age_Band_of_Driver, '^\d+-\d+$') THEN Age_Band_of_Driver END AS strict FROM vehicles""",
    ["vehicles"],
)
def age_bands_matching(d):
    both = d.vehicles.withColumns({"loose": F.col("Age_Band_of_Driver"), "strict": F.col("Age_Band_of_Driver")})
    both = clean.null_if_not_matching(both, "loose")
    return clean.null_if_not_matching(both, "strict", presets.STRICT_AGE_BAND_PATTERN)


@query(
    "null_if_sentinel",
    "Accident_Index:i Vehicle_Reference:i Age_Band_of_Driver:s",
    """SELECT Accident_Index, Vehicle_Reference, nullif(Age_Band_of_Driver, 'Data missing or out of range') AS Age_Band_of_Driver
       FROM vehicles""",
    ["vehicles"],
)
def null_if_sentinel(d):
    return clean.null_if_sentinel(d.vehicles, "Age_Band_of_Driver")


@query(
    "recode_sex",
    "Accident_Index:i Vehicle_Reference:i Sex_of_Driver:s",
    """SELECT Accident_Index, Vehicle_Reference, CASE WHEN Sex_of_Driver IN ('Male', 'M', '1') THEN 'Male'
         WHEN Sex_of_Driver IN ('Female', 'F', '2') THEN 'Female' ELSE 'Not known' END AS Sex_of_Driver FROM vehicles""",
    ["vehicles"],
)
def recode_sex(d):
    return clean.recode_with_fallback(d.vehicles)


@query(
    "select_numeric",
    "Accident_Index:i Speed_limit:f Latitude:f Number_of_Vehicles:i width:i",
    "SELECT Accident_Index, Speed_limit, Latitude, Number_of_Vehicles, 9 AS width FROM accidents",
    ["accidents"],
)
def numeric_only(d):
    out = select_numeric(d.accidents)
    return out.withColumn("width", F.lit(len(out.columns)))


@query(
    "exclude_leakage",
    "Accident_Index:i Speed_limit:f width:i",
    "SELECT Accident_Index, Speed_limit, 24 AS width FROM accidents",
    ["accidents"],
)
def exclude_leakage(d):
    out = clean.exclude_leakage(d.accidents)
    return out.withColumn("width", F.lit(len(out.columns)))


@query(
    "to_numeric_safe",
    "Accident_Index:i Vehicle_Reference:i sex_code:f band:f",
    """SELECT Accident_Index, Vehicle_Reference, TRY_CAST(Sex_of_Driver AS DOUBLE) AS sex_code,
         TRY_CAST(Age_Band_of_Driver AS DOUBLE) AS band FROM vehicles""",
    ["vehicles"],
)
def to_numeric_safe(d):
    typed = d.vehicles.withColumns({"sex_code": F.col("Sex_of_Driver"), "band": F.col("Age_Band_of_Driver")})
    return clean.to_numeric(typed, ["sex_code", "band"])


@query(
    "speeds_with_many_rows",
    "Speed_limit:i Accidents:i SevereRate:f",
    """SELECT Speed_limit, count(*) AS Accidents, avg(CASE WHEN Accident_Severity IN ('Fatal', 'Serious') THEN 1e0 ELSE 0e0 END) AS SevereRate
       FROM accidents WHERE Speed_limit IS NOT NULL GROUP BY Speed_limit HAVING count(*) > 100""",
    ["accidents"],
)
def speeds_with_many_rows(d):
    return clean.having_more_than(rollups.severe_rate_by(rollups.severe_flag(d.accidents), "Speed_limit"), "Accidents", 100)


@query(
    "upper_tail_trim",
    "Accident_Index:i Vehicle_Reference:i Engine_Capacity_CC:i",
    """SELECT Accident_Index, Vehicle_Reference, Engine_Capacity_CC FROM vehicles WHERE Engine_Capacity_CC > 0 AND Engine_Capacity_CC <=
         (SELECT quantile_cont(CAST(Engine_Capacity_CC AS DOUBLE), 0.99) FROM vehicles WHERE Engine_Capacity_CC > 0)""",
    ["vehicles"],
)
def upper_tail_trim(d):
    return rollups.upper_tail_trim(d.vehicles, "Engine_Capacity_CC")


@query(
    "drop_unmapped_labels",
    "Accident_Index:i Accident_Severity:i",
    """SELECT Accident_Index, CASE Accident_Severity WHEN 'Slight' THEN 0 WHEN 'Serious' THEN 1 ELSE 2 END AS Accident_Severity
       FROM accidents WHERE Accident_Severity IN ('Slight', 'Serious', 'Fatal')""",
    ["accidents"],
)
def drop_unmapped_labels(d):
    return features.encode_target(d.accidents)


@query(
    "distinct_rows",
    "Accident_Index:i Vehicle_Reference:i Year:i",
    "SELECT DISTINCT * FROM (SELECT * FROM vehicles UNION ALL SELECT * FROM vehicles WHERE Vehicle_Reference = 2)",
    ["vehicles"],
)
def distinct_rows(d):
    return clean.distinct_rows(d.vehicles.unionByName(d.vehicles.where("Vehicle_Reference = 2")))


@query(
    "union_train_val",
    "split:s n:i speed_sum:i",
    """SELECT 'train' AS split, count(*) AS n, coalesce(sum(Speed_limit), 0) AS speed_sum FROM accidents WHERE Number_of_Vehicles > 2
       UNION ALL SELECT 'val', count(*), coalesce(sum(Speed_limit), 0) FROM accidents WHERE Number_of_Vehicles <= 2""",
    ["accidents"],
)
def union_train_val(d):
    rows = d.accidents.select("Speed_limit", "Number_of_Vehicles")
    train = rows.where("Number_of_Vehicles > 2").withColumn("split", F.lit("train"))
    val = rows.where("Number_of_Vehicles <= 2").withColumn("split", F.lit("val"))
    both = train.unionByName(val)
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("Speed_limit"), F.lit(0)).alias("speed_sum"))


@query(
    "unexpected_labels",
    "label:s",
    "SELECT DISTINCT Accident_Severity AS label FROM accidents EXCEPT SELECT unnest(['Fatal', 'Serious', 'Slight'])",
    ["accidents"],
)
def unexpected_labels(d):
    return features.unexpected_labels(d.accidents, "Accident_Severity")


@query(
    "cleaning_filter_counts",
    "step:s rows_after:i",
    f"""SELECT 'initial' AS step, count(*) AS rows_after FROM accidents
        UNION ALL SELECT 'valid_speed', count(*) FROM accidents WHERE Speed_limit IN {_SPEEDS}
        UNION ALL SELECT 'has_place', count(*) FROM accidents WHERE Speed_limit IN {_SPEEDS} AND Latitude IS NOT NULL AND Longitude IS NOT NULL
        UNION ALL SELECT 'has_label', count(*) FROM accidents WHERE Speed_limit IN {_SPEEDS} AND Latitude IS NOT NULL AND Longitude IS NOT NULL
          AND Accident_Severity IN ('Fatal', 'Serious', 'Slight')""",
    ["accidents"],
)
def cleaning_filter_counts(d):
    steps = [
        ("valid_speed", F.col("Speed_limit").isin(*presets.SPEED_LIMITS)),
        ("has_place", F.col("Latitude").isNotNull() & F.col("Longitude").isNotNull()),
        ("has_label", fx.is_member("Accident_Severity", presets.LABELS)),
    ]
    return clean.filter_counts(d.accidents, steps)


_CLEAN_WHERE = f"Speed_limit IN {_SPEEDS} AND Latitude IS NOT NULL AND Longitude IS NOT NULL"


@query(
    "cleaned_accidents",
    "Accident_Index:i Speed_limit:i Latitude:f Longitude:f Day_of_Week:s",
    f"SELECT DISTINCT Accident_Index, Speed_limit, Latitude, Longitude, dayname(Date) AS Day_of_Week FROM accidents WHERE {_CLEAN_WHERE}",
    ["accidents"],
)
def cleaned_accidents(d):
    return clean.clean(d.accidents)


@query(
    "cleaning_audit",
    "step:s rows_before:i rows_after:i removed:i total_removed:i removed_pct:f",
    f"""WITH pairs AS (SELECT Accident_Index, Speed_limit, Latitude, Longitude, Vehicle_Reference FROM accidents JOIN vehicles USING (Accident_Index)),
        steps AS (
          SELECT 1 AS i, 'initial' AS step, count(*) AS n FROM pairs
          UNION ALL SELECT 2, 'valid_speed', count(*) FROM pairs WHERE Speed_limit IN {_SPEEDS}
          UNION ALL SELECT 3, 'required_fields', count(*) FROM pairs WHERE {_CLEAN_WHERE}
          UNION ALL SELECT 4, 'distinct', count(*) FROM (SELECT DISTINCT * FROM pairs WHERE {_CLEAN_WHERE}))
        SELECT step, coalesce(lag(n) OVER (ORDER BY i), n) AS rows_before, n AS rows_after,
          coalesce(lag(n) OVER (ORDER BY i), n) - n AS removed, first_value(n) OVER (ORDER BY i) - n AS total_removed,
          round(100e0 * (first_value(n) OVER (ORDER BY i) - n) / first_value(n) OVER (ORDER BY i), 2) AS removed_pct FROM steps""",
    ["accidents", "vehicles"],
)
def cleaning_audit(d):
    rows = d.accidents.select("Accident_Index", "Speed_limit", "Latitude", "Longitude").join(
        d.vehicles.select("Accident_Index", "Vehicle_Reference"), "Accident_Index"
    )
    audit = clean.CleaningAudit()
    clean.clean(rows, audit).count()
    return d.spark.createDataFrame(audit.table(), "step string, rows_before long, rows_after long, removed long, total_removed long, removed_pct double")
