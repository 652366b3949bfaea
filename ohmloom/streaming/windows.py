"""The tumbling-window aggregates over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, by: tuple[str, ...] = ("entity_id", "sensor"), ts: str = "ts", value: str = "value", size: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Minimal features of each window and series; windows close when the watermark passes them."""
    v = F.col(value)
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, size), *by)
        .agg(F.count(v).alias("length"), F.sum(v).alias("sum_values"), F.avg(v).alias("mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.stddev_pop(v).alias("standard_deviation"), F.sqrt(F.avg(v * v)).alias("root_mean_square"))
        .select(F.col("window.start").alias("window_id"), *by, "length", "sum_values", "mean", "minimum", "maximum", "standard_deviation", "root_mean_square")
    )
