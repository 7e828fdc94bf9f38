"""End-to-end flows: integrate and clean, engineer, preprocess, split and balance, train."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import presets
from tarmac.operators import balance, clean, evaluate, impute, joins, models, select
from tarmac.operators import features as fe
from tarmac.operators import groupstats
from tarmac.schema import col, numeric_columns, string_columns
from tarmac.session import cut_lineage


@dataclass
class Config:
    """Defaults of the preprocessing flow."""

    test_size: float = 0.2
    val_size: float = 0.5
    random_state: int = 42
    missing_threshold: float = 50.0
    feature_selection_method: str = "model_based"
    rfecv_min_features: int = 15
    rfecv_cv_folds: int = 5
    top_k: int = 15
    compare_feature_selection: bool = False
    apply_smote: bool = True
    smote_targets: Mapping | None = None
    use_tomek: bool = False


def integrate_and_clean(accidents: DataFrame, vehicles: DataFrame, stations: DataFrame, weather: DataFrame, how: str = "left") -> DataFrame:
    # The joined table serves the null shares and the rows: it is computed once.
    return clean.clean(cut_lineage(joins.integrate(accidents, vehicles, stations, weather, how)))


def engineer(df: DataFrame, encoding: groupstats.GroupEncoding | None = None, **skew_options) -> DataFrame:
    """All features. Scores that read texts come before the texts turn into codes."""
    out = fe.temporal_features(df)
    out = fe.rush_hour_flag(out)
    out = fe.lighting_features(out)
    out = fe.road_surface_flag(out)
    out = fe.weather_text_flag(out)
    out = fe.urban_flag(out)
    out = fe.weather_measure_flag(out)
    out = fe.road_risk_score(out)
    out = fe.weather_composites(out)
    out = fe.vehicle_features(out, **skew_options)
    out = fe.vehicle_attributes(out)
    out = fe.driver_features(out)
    out = fe.manoeuvre_code(out)
    out = fe.junction_codes(out)
    out = fe.journey_purpose_code(out)
    out = groupstats.admin_features(out, encoding)
    out = fe.interaction_features(out)
    return fe.road_type_code(out)


def preprocess(df: DataFrame, config: Config = Config(), label: str = "Accident_Severity", key: str = "Accident_Index") -> tuple[DataFrame, DataFrame]:
    """Impute, clip, label-encode. Returns the table and the outlier statistics."""
    # Shares, medians, fences and codes each read the table: it is computed once per stage.
    out = cut_lineage(impute.handle_missing(cut_lineage(df), config.missing_threshold))
    out, stats = impute.outlier_clip(out)
    out = cut_lineage(out)
    skip = [label, key, "Date", "Day_of_Week"]
    return impute.encode_categorical(out, string_columns(out, skip), method="label"), stats


@dataclass
class Prepared:
    """Scaled rows with their split, and the state that was fitted on the training rows."""

    rows: DataFrame
    features: list[str]
    scaler: impute.Scaler
    selection: dict = field(default_factory=dict)


def choose_features(df: DataFrame, label: str, key: str, config: Config) -> tuple[list[str], dict]:
    candidates = numeric_columns(df, [label, key])
    if config.compare_feature_selection:
        found = select.compare_selectors(
            df, candidates, label, key, config.feature_selection_method,
            min_features=config.rfecv_min_features, folds=config.rfecv_cv_folds,
        )
        return found["selected"], {k: v for k, v in found.items() if isinstance(v, list)}
    if config.feature_selection_method == "rfecv":
        kept, _ = select.select_rfecv(df, candidates, label, key, min_features=config.rfecv_min_features, folds=config.rfecv_cv_folds)
    else:
        kept, _ = select.select_model_based(df, candidates, label, top_k=config.top_k, seed=config.random_state)
    return kept, {config.feature_selection_method: kept}


def split_balance_scale(
    df: DataFrame, label: str, key: str, features: Sequence[str], config: Config = Config()
) -> Prepared:
    """Split, oversample the training rows only, and scale everything by the training rows."""
    features = list(features)
    filled = impute.impute_for_balancing(df.select(col(key), col(label), *[col(f) for f in features if f not in (key, label)]), features)
    filled = cut_lineage(filled)
    split = balance.train_val_test(filled, label, key, config.test_size, config.val_size, config.random_state)
    train = split.where(F.col("split") == "train").drop("split")
    if config.apply_smote:
        grow = balance.smote_tomek if config.use_tomek else balance.smote
        train = grow(train, label, key, features, config.smote_targets, seed=config.random_state)
    else:
        train = train.withColumns({key: col(key).cast("string"), "is_synthetic": F.lit(0)})
    held = split.where(F.col("split") != "train").withColumns({key: col(key).cast("string"), "is_synthetic": F.lit(0)})
    # The scaler, each fit, the thresholds and the scores read these rows: neighbours are searched once.
    rows = cut_lineage(train.withColumn("split", F.lit("train")).unionByName(held))
    scaler = impute.Scaler.fit(rows.where(F.col("split") == "train"), features)
    return Prepared(scaler.transform(rows), features, scaler)


def train_and_evaluate(
    rows: DataFrame, label: str, features: Sequence[str], fitters: Mapping, labels: Sequence[str] = presets.LABELS, grid=None
) -> DataFrame:
    """(model, base_f1, thresholded_f1, delta) for each fitter; thresholds come from the val rows."""
    train, val, test = (rows.where(F.col("split") == s) for s in ("train", "val", "test"))
    # Every row passes all trees: no task should have many of them.
    val, test = (select._spread(part, models.DEEP_ROWS_PER_TASK) for part in (val, test))
    scored = None
    for name, fit in fitters.items():
        model = fit(train)
        p = [f"p{i}" for i in range(len(labels))]
        spread = {c: F.col("probabilities")[i] for i, c in enumerate(p)}
        thresholds = evaluate.best_thresholds(model.probabilities(val).withColumns(spread), label, p, labels, grid)
        out = model.transform(test)
        out = evaluate.predict_with_thresholds(out, F.col("probabilities"), thresholds, labels, "thresholded")
        # Both scores read the predictions: they are made once.
        part = cut_lineage(out.select(F.lit(name).alias("model"), col(label), "prediction", "thresholded"))
        scored = part if scored is None else scored.unionByName(part)
    return evaluate.compare_runs(scored, "model", label, "prediction", "thresholded")


def severe_rate_by_conditions(merged: DataFrame) -> DataFrame:
    """Severe rate by speed limit and darkness over integrated, cleaned accidents."""
    out = clean.filter_valid_set(merged)
    out = clean.require_non_null(out, ["Latitude", "Longitude", "Speed_limit", "Accident_Index"])
    out = fe.temporal_features(out)
    out = fe.lighting_features(out)
    out = fe.weather_measure_flag(out)
    out = fe.road_risk_score(out)
    out = fe.weather_composites(out)
    return out
