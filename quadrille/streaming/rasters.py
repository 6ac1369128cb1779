"""Structured Streaming forms of point sampling and date statistics, beyond what batch users need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Grid
from ..operators.geometry import sample_points


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def sample_stream(points: DataFrame, pixels: DataFrame, grid: Grid, values: list[str]) -> DataFrame:
    """A stream of points (x, y) with the values of a static raster's pixels: a stream-static join."""
    return sample_points(points, pixels, grid, values)


def daily_stats(events: DataFrame, time: str, value: str, late: str = "1 day") -> DataFrame:
    """Mean, least and greatest value of each day, once the watermark has passed it."""
    days = events.withWatermark(time, late).groupBy(F.window(time, "1 day"))
    return days.agg(F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")).select(F.to_date("window.start").alias("date"), "mean", "lo", "hi", "n")
