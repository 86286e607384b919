"""Scoring a stream with a fitted model, and windowed error metrics over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored_stream(stream: DataFrame, model, **names) -> DataFrame:
    """A model's ``predict`` is a projection and so runs on a stream as it is."""
    return model.predict(stream, **names)


def windowed_error(stream: DataFrame, time: str, actual: str, predicted: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, n, rmse) of each event-time window; rows later than ``late`` are dropped."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col(actual) - F.col(predicted), 2))).alias("rmse")).select(F.col("w.start").alias("start"), "n", "rmse")
