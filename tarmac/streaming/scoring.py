"""Streams: row-local feature chains with fitted models, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators import features as fe
from tarmac.operators.models import Scored
from tarmac.schema import col


def row_local_features(df: DataFrame) -> DataFrame:
    """The feature operators that need no other row, in an order that keeps texts readable."""
    out = fe.temporal_features(df)
    out = fe.lighting_features(out)
    out = fe.road_surface_flag(out)
    out = fe.weather_text_flag(out, target="is_adverse_weather")
    out = fe.urban_flag(out)
    out = fe.road_risk_score(out)
    out = fe.interaction_features(out)
    return fe.road_type_code(out)


def score_stream(
    stream: DataFrame,
    model: Scored,
    prepare: Callable[[DataFrame], DataFrame] = row_local_features,
    thresholds: Sequence[float] | None = None,
) -> DataFrame:
    """Prediction, probabilities and confidence per record; stateless, so it needs no watermark."""
    return model.transform(prepare(stream), thresholds)


def resample_stream(stream: DataFrame, time: str = "ts", period: str = "1 day", late: str = "1 day", by: Sequence[str] = ()) -> DataFrame:
    """(period, …by, n) per tumbling window. Unlike the batch roll-up, empty periods do not appear."""
    # A watermark needs an instant; a time without zone counts as UTC session time.
    stream = stream.withColumn(time, col(time).cast("timestamp"))
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(col(time), period), *[col(c) for c in by])
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("period"), *[col(c) for c in by], "n")
    )


def read_stream(spark, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append"):
    """Process what is there, write parquet, stop. The checkpoint belongs on shared storage."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(output_mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there and keep the whole aggregate, the open windows included."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = (
        stream.writeStream.foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
