"""Structured Streaming forms: the stateless cull filter, and windowed statistics of observations with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators import observations as obs


def corner_stream(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Corner files (Parquet) as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def cull(stream: DataFrame, left_of: float | None = None, radius: float | None = None, width: int = 0, height: int = 0) -> DataFrame:
    """Row by row, so without state: works on batches and streams alike."""
    if left_of is not None:
        stream = obs.cull_left_of(stream, left_of)
    return obs.cull_off_center(stream, radius, width, height) if radius is not None else stream


def windowed(events: DataFrame, time: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and population deviation per window; state is dropped once the watermark passes a window's end."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev")).select(F.col("w.start").alias("start"), "n", "mean", "stdev")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with no gap longer than given."""
    grouped = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
