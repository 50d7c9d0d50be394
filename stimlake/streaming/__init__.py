"""Readings as they are delivered: the batch clean-up's first step on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(readings: DataFrame, late: str = "2 days") -> DataFrame:
    """Each delivered-again row once.

    readings: a stream with ``row_id`` and ``logged_at``; a repeat that comes later than ``late`` after the first
    is let through again, as the state of older rows is dropped.
    """
    return readings.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["row_id"])


def delivery_rates(readings: DataFrame, window: str = "10 minutes", late: str = "2 days") -> DataFrame:
    """Readings, absent values and greatest value of each recording and channel in each window of delivery."""
    r = readings.withWatermark("logged_at", late).withColumn("channel", F.lower(F.trim("channel")))
    bad = F.col("v").isNull() | F.isnan("v")
    return r.groupBy(F.window("logged_at", window), "expt", "channel").agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("n_absent"), F.max(F.when(~bad, F.col("v"))).alias("top"))
