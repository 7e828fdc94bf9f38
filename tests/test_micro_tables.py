"""Literal rows in, exact rows out; every table has null rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarmac import presets
from tarmac.functions import scalar as fx
from tarmac.operators import balance, clean, evaluate, groupstats, impute, profile, quality, rollups
from tarmac.operators import features as fe


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def frame(spark, values, dtype, name="x"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, {name} {dtype}")


@pytest.mark.parametrize(
    "name, values, expected",
    [
        ("prcp", [0.0, 2.5, 0.0, 5.0, None], [0, 1, 0, 1, 0]),
        ("snwd", [0.0, 0.0, 5.0, 10.0, None], [0, 0, 1, 1, 0]),
        ("cldc", [5.0, 6.0, 8.0, None], [0, 1, 1, 0]),
    ],
)
def test_weather_measure_flag(spark, name, values, expected):
    assert column(fe.weather_measure_flag(frame(spark, values, "double", name)), "is_adverse_weather") == expected


def test_lighting(spark):
    df = frame(spark, ["Daylight", "Darkness - lights lit", "Darkness - no lights", None], "string", "Light_Conditions")
    out = fe.lighting_features(df)
    assert column(out, "is_dark") == [0, 1, 1, 0]
    assert "Light_Conditions" not in out.columns
    assert column(fe.lighting_features(df.drop("Light_Conditions")), "is_dark") == [0, 0, 0, 0]


def test_flags_count_null_as_different(spark):
    df = frame(spark, ["Dry", "Wet or damp", None], "string", "Road_Surface_Conditions")
    assert column(fe.road_surface_flag(df), "is_wet_road") == [0, 1, 1]
    df = frame(spark, ["Fine no high winds", "Raining", None], "string", "Weather_Conditions")
    assert column(fe.weather_text_flag(df), "is_adverse_weather_text") == [0, 1, 1]


def test_urban(spark):
    df = frame(spark, ["Urban", "BUILT-UP", "Rural", "Unallocated", None], "string", "Urban_or_Rural_Area")
    assert column(fe.urban_flag(df), "is_urban") == [1, 1, 0, 0, 0]
    assert column(fe.urban_flag(df, variant="exact"), "is_urban") == [1, 0, 0, 1, 0]


def test_temporal(spark):
    days = [dt.date(2023, 1, 1), dt.date(2023, 3, 6), None]
    out = fe.temporal_features(frame(spark, days, "date", "Date"))
    assert column(out, "day_of_week") == [6, 0, None]
    assert column(out, "is_weekend") == [1, 0, 0]
    assert column(out, "season") == ["Winter", "Spring", None]
    text = fe.temporal_features(frame(spark, ["2023-07-04 13:45:00", "not a date", None], "string", "Date"))
    assert column(text, "hour_of_day") == [13, None, None]
    no_date = frame(spark, [1], "int")
    assert fe.temporal_features(no_date).columns == no_date.columns


def test_road_risk_uses_text(spark):
    df = spark.createDataFrame(
        [(0, 60, "Single carriageway"), (1, None, "Roundabout"), (2, 15, None), (3, 70, "Slip road")], "i int, Speed_limit int, Road_Type string"
    )
    # 5*1.5, 2*0.8, 3*1.5, 6*0.7
    assert column(fe.road_risk_score(df), "road_risk_score") == [7, 1, 4, 4]


def test_engine_bins_are_right_closed(spark):
    df = frame(spark, [0, 1, 1400, 1401, 2000, 4000, 4001, None], "int", "Engine_Capacity_CC")
    assert column(fe.vehicle_attributes(df), "engine_size_category") == [-1, 0, 0, 1, 1, 2, 3, -1]


def test_code_maps_have_defaults(spark):
    df = frame(spark, ["Car", "Electric motorcycle", "Tram", None], "string", "Vehicle_Type")
    assert column(fe.vehicle_attributes(df), "Vehicle_Type") == [0, 5, 4, 4]
    df = frame(spark, ["U-turn", "Flying", None], "string", "Vehicle_Manoeuvre")
    assert column(fe.manoeuvre_code(df), "manoeuvre_encoded") == [2, -1, -1]
    df = frame(spark, ["26 - 35", "999", None], "string", "Age_Band_of_Driver")
    assert column(fe.driver_features(df), "age") == [30.0, 30.0, 30.0]


def test_age_bands(spark):
    df = frame(spark, ["26 - 35", "26-35", "Over 75", "Invalid", "999", None], "string", "Age_Band_of_Driver")
    assert column(clean.null_if_not_matching(df), "Age_Band_of_Driver") == ["26 - 35", "26-35", "Over 75", None, None, None]
    strict = clean.null_if_not_matching(df, pattern=presets.STRICT_AGE_BAND_PATTERN)
    assert column(strict, "Age_Band_of_Driver") == [None, "26-35", None, None, None, None]


def test_sex_codes(spark):
    df = frame(spark, ["Male", "F", "3", "X", "999", None], "string", "Sex_of_Driver")
    assert column(clean.recode_with_fallback(df), "Sex_of_Driver") == ["Male", "Female", "Not known", "Not known", "Not known", "Not known"]


def test_speed_filter_drops_nulls(spark):
    df = frame(spark, [20, 30, -5, 999, 50, 0, None], "int", "Speed_limit")
    assert column(clean.filter_valid_set(df), "Speed_limit") == [20, 30, 50]


def test_weekday_modes(spark):
    df = spark.createDataFrame([(0, dt.date(2023, 1, 2), "Friday"), (1, None, "Friday")], "i int, Date date, Day_of_Week string")
    assert column(clean.fix_day_of_week(df), "Day_of_Week") == ["Monday", "Friday"]
    assert clean.fix_day_of_week(df, mode="drop").columns == ["i"]
    with pytest.raises(ValueError):
        clean.fix_day_of_week(df, mode="other")


def test_sparse_columns(spark):
    df = spark.createDataFrame([(i, None if i else "x", i) for i in range(40)], "i int, thin string, full int")
    assert clean.drop_sparse_columns(df, []).columns == ["i", "full"]
    assert clean.drop_columns_over_missing(df, 20).columns == ["i", "full"]
    assert "thin" in clean.drop_columns_over_missing(df, 20, keep=["thin"]).columns


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 4), (2, 5), (2, 5), (3, 6), (3, None), (3, None)], "a int, b int")
    assert clean.distinct_rows(df).count() == 4
    row = profile.duplicate_counts(df, ["a", "b"], "a").first()
    assert (row["full_duplicates"], row["composite_duplicates"], row["key_repeats"]) == (2, 2, 3)
    found = sorted((r["a"], r["b"] or 0) for r in profile.duplicate_rows(df).collect())
    assert found == [(2, 5), (2, 5), (3, 0), (3, 0)]


def test_duplicate_rows_compute_fingerprints_once_for_hot_keys_and_counts(spark):
    made = spark.sparkContext.accumulator(0)

    def tell(x):
        made.add(1)
        return x

    df = spark.range(60).select(F.udf(tell, "long")(F.col("id") % 40).alias("a"))
    found = profile.duplicate_rows(df, rows_per_salt=1, small_bytes=0)
    assert sorted(r["a"] for r in found.collect()) == sorted([*range(20), *range(20)])
    assert made.value == 120  # once for hot keys and counts, once for the members


def test_row_fingerprint_keeps_null_places_apart(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), ("x", None)], "a string, b string")
    assert profile.duplicate_counts(df.withColumn("k", F.lit(1)), ["k"], "k").first()["full_duplicates"] == 1


def test_clean_rejects_no_columns(spark):
    with pytest.raises(ValueError):
        clean.clean(spark.createDataFrame([()], "struct<>"))


def test_mixed_quality_rows_pass_cleaning(spark):
    rows = [
        ("a", "2023-01-01", 30, "Slight", 51.0, -1.0),
        ("b", "bad", 999, "Unknown", None, -1.0),
        ("c", None, None, None, 52.0, None),
        ("a", "2023-01-01", 30, "Slight", 51.0, -1.0),
    ]
    df = spark.createDataFrame(rows, "Accident_Index string, Date string, Speed_limit int, Accident_Severity string, Latitude double, Longitude double")
    audit = clean.CleaningAudit()
    out = clean.clean(df.drop("Date"), audit)
    assert [r["Accident_Index"] for r in out.collect()] == ["a"]
    table = audit.table()
    assert [r["rows_after"] for r in table] == [4, 2, 2, 1]
    assert table[-1]["total_removed"] == 3


def test_histogram_closes_last_bin_and_keeps_empty_ones(spark):
    df = frame(spark, [0.0, 1.0, 10.0, 10.0, None], "double")
    counts = [r["n"] for r in profile.histogram(df, ["x"]).orderBy("bin").collect()]
    assert counts == [1, 1, 0, 0, 0, 0, 0, 0, 0, 2]
    flat = [r["n"] for r in profile.histogram(frame(spark, [3.0] * 4, "double"), ["x"]).orderBy("bin").collect()]
    assert sum(flat) == 4 and flat[5] == 4


def test_clip_keeps_rows(spark):
    df = frame(spark, [20, 30, 30, 30, 40, 999], "int", "Speed_limit")
    out, stats = impute.outlier_clip(df)
    assert out.count() == 6 and max(column(out, "Speed_limit")) < 999
    assert [r["n_outliers"] for r in stats.where("column = 'Speed_limit'").collect()] == [1]
    holed, none = impute.outlier_clip(frame(spark, [1, 2, None, 999], "int"), None)
    assert 999 in column(holed, "x")


def test_label_codes_follow_text_order(spark):
    df = frame(spark, ["b", "A", None, "a", "b"], "string")
    assert column(impute.label_encode(df, "x"), "x") == [3, 0, 1, 2, 3]


def test_onehot_keeps_all_levels(spark):
    out = impute.encode_categorical(frame(spark, ["a", "b", None], "string"), ["x"])
    assert out.columns == ["i", "x_a", "x_b"]
    assert column(out, "x_a") == [1, 0, 0]


def test_scaler_uses_population_deviation(spark):
    df = frame(spark, [1.0, 3.0, None], "double")
    scaler = impute.Scaler.fit(df, ["x"])
    assert column(scaler.transform(df), "x") == [-1.0, 1.0, 0.0]
    assert column(impute.Scaler.fit(frame(spark, [5.0, 5.0], "double"), ["x"]).transform(frame(spark, [5.0, 6.0], "double")), "x") == [0.0, 1.0]


def test_group_encoding_defaults(spark):
    df = spark.createDataFrame(
        [(0, "x", "Slight"), (1, "x", "Fatal"), (2, "y", "Serious"), (3, None, "Slight")], "i int, g string, Accident_Severity string"
    )
    enc = groupstats.fit_group_encoding(df, ["g"])
    assert column(enc.attach(df, "g", "m", "v"), "m") == [2.0, 2.0, 2.0, 1.0]
    assert column(enc.attach(df, "g", "m", "v"), "v") == [2.0, 2.0, 1.0, 1.5]
    codes = fe.encode_target(df)
    assert column(groupstats.fit_group_encoding(codes, ["g"]).attach(codes, "g", "m", None), "m") == [2.0, 2.0, 2.0, 1.0]
    unseen = frame(spark, ["z"], "string", "g")
    assert column(enc.attach(unseen, "g", "m", "v"), "m") == [1.0]


def test_labels(spark):
    df = frame(spark, ["0", "1", "2", "Fatal"], "string", "y")
    assert column(fe.normalise_labels(df, "y"), "y") == ["Slight", "Serious", "Fatal", "Fatal"]
    with pytest.raises(ValueError, match="unexpected labels"):
        fe.normalise_labels(frame(spark, ["0", "what"], "string", "y"), "y")
    assert column(fe.encode_target(frame(spark, [2, 0], "int", "Accident_Severity")), "Accident_Severity") == [2, 0]


def test_thresholds(spark):
    rows = [(0, 0.2, 0.3, 0.5), (1, 0.1, 0.1, 0.8), (2, 0.3, 0.3, 0.4)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    p = F.array("a", "b", "c")
    assert column(evaluate.predict_with_thresholds(df, p, [0.05, 0.29, 0.6]), "prediction") == ["Fatal", "Slight", "Fatal"]
    # No class clears its threshold: the most probable class.
    assert column(evaluate.predict_with_thresholds(df, p, [0.9, 0.9, 0.9]), "prediction") == ["Slight", "Slight", "Slight"]
    assert evaluate.best_thresholds(df, "y", None) == [0.33, 0.33, 0.33]


def test_threshold_search_range_and_first_best(spark):
    rows = [("Fatal", 0.6, 0.2, 0.2), ("Serious", 0.2, 0.6, 0.2), ("Slight", 0.1, 0.1, 0.8)] * 2
    df = spark.createDataFrame(rows, "y string, a double, b double, c double")
    row = evaluate.threshold_search(df, "y", ["a", "b", "c"]).first()
    assert row["macro_f1"] == 1.0
    grid = presets.training_grid()
    assert len(grid) == 700 and len(presets.tuning_grid()) == 700
    first = next(t for t in grid if evaluate.summary_metrics(
        evaluate.pair_counts(evaluate.predict_with_thresholds(df, F.array("a", "b", "c"), t), "y")).first()["macro_f1"] == 1.0)
    assert (row["threshold_fatal"], row["threshold_serious"], row["threshold_slight"]) == first


def test_metrics_of_empty_classes_are_zero(spark):
    df = spark.createDataFrame([("Slight", "Slight"), ("Slight", "Serious")], "label string, prediction string")
    row = evaluate.business_metrics(df).first()
    assert (row["fatal_recall"], row["critical_case_recall"], row["weighted_cost"]) == (0.0, 0.0, 0.5)
    # Macro F1 runs over the classes that occur, the report over the listed ones.
    assert evaluate.summary_metrics(evaluate.pair_counts(df)).first()["macro_f1"] == pytest.approx((2 / 3 + 0) / 2)
    report = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert report["macro avg"]["f1"] == pytest.approx((2 / 3) / 3)
    matrix = evaluate.confusion_matrix(df).orderBy("position").collect()
    assert [tuple(r)[2:] for r in matrix] == [(0, 0, 0), (0, 0, 0), (0, 1, 1)]


@pytest.mark.parametrize("labels", [[], ["a", "a"]])
def test_evaluate_checks_inputs(spark, labels):
    df = spark.createDataFrame([("a", "a")], "label string, prediction string")
    with pytest.raises(ValueError):
        evaluate.evaluate(df, labels=labels)
    with pytest.raises(ValueError):
        evaluate.evaluate(df.limit(0))
    with pytest.raises(ValueError):
        evaluate.evaluate(df.drop("prediction"))


def test_validation_score(spark):
    with pytest.raises(ValueError):
        quality.validation_score(None)
    empty = spark.createDataFrame([], "a int")
    assert quality.validation_score(empty).first()["validation_score"] == 0.0
    good = spark.createDataFrame([(51.0,), (52.0,)], "Latitude double")
    assert quality.validation_score(good).first()["validation_score"] == 1.0


def test_balance_gate(spark):
    df = spark.createDataFrame([("Fatal",)] * 5 + [("Slight",)] * 95, "y string")
    assert profile.is_label_frequent(df, "y", "Fatal", 5.0)
    assert not profile.is_label_frequent(df, "y", "Fatal", 5.1)
    weights = {r["label"]: r["weight"] for r in balance.class_weights(df, "y").collect()}
    assert weights == {"Fatal": 10.0, "Slight": pytest.approx(100 / 190)}


def test_calendar_includes_empty_periods(spark):
    days = [dt.date(2023, 1, 31), dt.date(2023, 3, 1), dt.date(2023, 3, 2), None]
    out = rollups.calendar_counts(frame(spark, days, "date", "d"), "d", "month").orderBy("period").collect()
    assert [(str(r["period"]), r["n"]) for r in out] == [("2023-01-31", 1), ("2023-02-28", 0), ("2023-03-31", 2)]


def test_bad_casts_are_null_not_errors(spark):
    df = frame(spark, ["1.5", "abc", "", None], "string")
    assert column(df.withColumn("n", fx.to_number("x")), "n") == [1.5, None, None, None]
    assert column(df.withColumn("n", fx.to_day("x")), "n") == [None] * 4
    assert column(df.withColumn("n", fx.hour_of_time("x")), "n") == [None] * 4
