"""Sensor-window summaries; the same plan serves batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonnage.functions.scalar import epoch_micros, flag


def window_summary(
    readings: DataFrame, entity: str, sensor: str, ts: str, value: str, low: float, high: float, width: str = "2 minutes", watermark: str | None = None,
    identity: str | None = None,
) -> DataFrame:
    """Statistics per entity, sensor and tumbling window. A window's facts are available from its end.

    With `watermark`, a streaming input emits each window once, in append mode, when it can no longer change: readings up
    to that much behind the newest count, later ones are dropped. With `identity`, a reading sent again counts
    once: a repeat has the same identity, entity, sensor, time and value. A stream keeps a reading in mind only until the
    watermark has passed its time; a repeat that comes after that is dropped as late.
    """
    source = readings.withWatermark(ts, watermark) if watermark else readings
    if identity:
        source = source.dropDuplicates([identity, entity, sensor, ts, value])
    source = source.withColumn("window", F.window(ts, width))
    second = (epoch_micros(ts) - epoch_micros(F.col("window.start"))) / F.lit(1_000_000.0)
    x = F.col(value)
    out = source.groupBy(F.col(entity), F.col(sensor), "window").agg(
        F.count(F.lit(1)).alias("reading_count"),
        F.count(value).alias("value_count"),
        F.avg(x).alias("mean_value"),
        F.min(x).alias("minimum_value"),
        F.max(x).alias("maximum_value"),
        F.stddev_pop(x).alias("standard_deviation"),
        F.regr_slope(x, second).alias("slope"),
        (F.max(x) - F.min(x)).alias("amplitude"),
        (F.avg(flag(~x.between(low, high))) * 100.0).alias("out_of_range_pct"),
    )
    return out.select(
        entity,
        sensor,
        F.col("window.start").alias("window_start_ts"),
        F.col("window.end").alias("window_end_ts"),
        F.col("window.end").alias("feature_available_at_ts"),
        "reading_count",
        "mean_value",
        "minimum_value",
        "maximum_value",
        "standard_deviation",
        "slope",
        "amplitude",
        "out_of_range_pct",
        F.when(F.col("value_count") == 0, "MISSING").otherwise("VALID").alias("data_quality_status"),
    )


def stream_window_summary(stream: DataFrame, path: str, checkpoint: str, watermark: str = "10 minutes", **columns):
    """Start an append-mode query that writes finished windows as Parquet; returns the running query.

    A query stopped at any point goes on from `checkpoint`: state and offsets are read back, and the file sink's log holds
    each batch once, so a batch that runs again leaves no second copy for readers of `path`."""
    summary = window_summary(stream, watermark=watermark, **columns)
    return summary.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
