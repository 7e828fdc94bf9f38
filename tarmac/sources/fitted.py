"""Versioned storage of fitted state: model, scaler, label codes and thresholds."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.boosting import Forest
from tarmac.operators.deepforest import SCHEMA, DeepForest
from tarmac.operators.impute import Scaler
from tarmac.operators.models import Boosted, Deep, Scored


@dataclass
class Fitted:
    """What scoring needs: ``transform`` scales with the stored means, then predicts with the stored thresholds."""

    model: Scored
    scaler: Scaler | None = None
    thresholds: list[float] | None = None
    version: int = 0

    def transform(self, df: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
        scaled = df if self.scaler is None else self.scaler.transform(df)
        return self.model.transform(scaled, self.thresholds if thresholds is None else thresholds)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions saved under ``path``, in order; none when nothing was."""
    try:
        saved = spark.read.schema("version int, state string").parquet(os.path.join(path, "versions"))
    except AnalysisException:
        return []
    return sorted(r["version"] for r in saved.select("version").distinct().collect())  # one row per save


def save(spark: SparkSession, path: str, fitted: Fitted) -> int:
    """Store a new version and return its number; earlier ones stay. The version is listed last, so a save that breaks off is never loaded."""
    known = versions(spark, path)
    version = known[-1] + 1 if known else 1
    model = fitted.model
    state = {"labels": model.labels, "params": model.params, "thresholds": fitted.thresholds}
    if fitted.scaler is not None:
        state["scaler"] = {"mean": fitted.scaler.mean, "std": fitted.scaler.std}
    if isinstance(model, Boosted):
        state |= {"features": model.features, "forest": json.loads(model.forest.to_json())}
    elif isinstance(model, Deep):
        state |= {"features": model.features, "edges": model.forest.edges}
        model.forest.to_table(spark).write.mode("overwrite").parquet(os.path.join(path, f"trees-{version}"))
    else:
        state["stages"] = len(model.stages)
        for i, stage in enumerate(model.stages):
            stage.write().overwrite().save(os.path.join(path, f"stage-{version}-{i}"))
    spark.createDataFrame([(version, json.dumps(state))], "version int, state string").write.mode("append").parquet(os.path.join(path, "versions"))
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> Fitted:
    """The newest version, or the one asked for; a missing one raises FileNotFoundError."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {version or ''} of a fitted model under {path}")
    version = known[-1] if version is None else version
    saved = spark.read.schema("version int, state string").parquet(os.path.join(path, "versions"))
    state = json.loads(saved.where(F.col("version") == version).first()["state"])
    if "forest" in state:
        model = Boosted(state["labels"], [], state["params"], Forest(**state["forest"]), state["features"])
    elif "edges" in state:
        trees = spark.read.schema(SCHEMA).parquet(os.path.join(path, f"trees-{version}"))
        forest = DeepForest.from_table(trees, state["edges"], len(state["labels"]))
        model = Deep(state["labels"], [], state["params"], forest, state["features"])
    else:
        stages = [PipelineModel.load(os.path.join(path, f"stage-{version}-{i}")) for i in range(state["stages"])]
        model = Scored(state["labels"], stages, state["params"])
    scaler = Scaler(**state["scaler"]) if "scaler" in state else None
    return Fitted(model, scaler, state["thresholds"], version)
