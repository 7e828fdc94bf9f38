"""Structured Streaming over the test tables, run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import presets
from tarmac.catalog.learning import _FEATURES, _KEPT, _LABEL, SCORED_SPEC, SCORED_SQL, checked_scores, model_rows
from tarmac.catalog.registry import case_map, query
from tarmac.operators import features as fe
from tarmac.operators import models
from tarmac.session import new_path
from tarmac.sources import domain, fitted
from tarmac.streaming import scoring


def _stream(d, name):
    schema = domain.table(d.spark, d.sf_dir, name).schema
    return d.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d.sf_dir)


@query("resample_stream", "period:s event_type:s n:i", "SELECT date_trunc('day', ts)::DATE AS period, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def resample_stream(d):
    counts = scoring.resample_stream(_stream(d, "events"), "ts", "1 day", by=["event_type"])
    out = scoring.run_complete(counts, new_path(d.spark, "resample"), new_path(d.spark, "ckpt"))
    return out.withColumn("period", F.to_date("period"))


@query(
    "resample_stream_closed",
    "period:s n:i",
    """SELECT period, count(*) AS n FROM (SELECT date_trunc('day', ts)::DATE AS period, (SELECT max(ts) FROM events) AS newest FROM events)
       WHERE period + INTERVAL 1 DAY <= newest - INTERVAL 1 DAY GROUP BY 1""",
)
def resample_stream_closed(d):
    """Windows that the watermark has closed; state is dropped with them, and a late event changes nothing."""
    counts = scoring.resample_stream(_stream(d, "events"), "ts", "1 day")
    path, checkpoint = new_path(d.spark, "closed"), new_path(d.spark, "ckpt")
    scoring.run_to_table(counts, path, checkpoint)
    return d.spark.read.parquet(path).withColumn("period", F.to_date("period"))


@query(
    "row_local_features_stream",
    "Accident_Index:i is_dark:i is_wet_road:i is_urban:i Road_Type:i month:i",
    f"""SELECT Accident_Index, CASE WHEN contains(coalesce(Light_Conditions, ''), 'Darkness') THEN 1 ELSE 0 END AS is_dark,
          CASE WHEN Road_Surface_Conditions IS DISTINCT FROM 'Dry' THEN 1 ELSE 0 END AS is_wet_road,
          CASE WHEN regexp_matches(lower(coalesce(Urban_or_Rural_Area, '')), 'urban|built') THEN 1 ELSE 0 END AS is_urban,
          {case_map('Road_Type', presets.ROAD_TYPE_CODES, '1')} AS Road_Type, month(Date) AS month FROM accidents""",
    ["accidents"],
)
def row_local_features_stream(d):
    accidents = domain.view_over(d.spark, "accidents", {"orders": _stream(d, "orders")})
    path = new_path(d.spark, "features")
    scoring.run_to_table(scoring.row_local_features(accidents), path, new_path(d.spark, "ckpt"))
    return d.spark.read.parquet(path)


@query("score_stream", SCORED_SPEC, SCORED_SQL.replace(_KEPT, "true"), ["accidents"])
def score_stream(d):
    # Scored by the stored model, as a stream that starts later would be.
    store = new_path(d.spark, "fitted")
    fitted.save(d.spark, store, fitted.Fitted(models.fit_logistic(model_rows(d), _LABEL, _FEATURES)))
    model = fitted.load(d.spark, store)

    def prepare(df):
        out = fe.road_surface_flag(fe.lighting_features(fe.urban_flag(fe.road_risk_score(df))))
        return out.select("Accident_Index", *[F.col(c).cast("double").alias(c) for c in _FEATURES]).dropna()

    accidents = domain.view_over(d.spark, "accidents", {"orders": _stream(d, "orders")})
    path = new_path(d.spark, "scored")
    out = scoring.score_stream(accidents, model, prepare).select("Accident_Index", "prediction", "probability_map", "confidence")
    scoring.run_to_table(out, path, new_path(d.spark, "ckpt"))
    return checked_scores(d.spark.read.parquet(path))
