"""An extension: occupancy targets of a stream of status snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_targets(status: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Per station and window: observations and the mean and extremes of bikes.

    status: station_id, ts (timestamp), bikes. A snapshot that arrives twice
    within the watermark counts once; later ones are dropped, so the state is
    bounded by stations times the watermark. Works on batch tables as well.
    """
    rows = status.withWatermark("ts", watermark)
    rows = rows.dropDuplicatesWithinWatermark(["station_id", "ts"]) if status.isStreaming else rows.dropDuplicates(["station_id", "ts"])
    g = rows.groupBy("station_id", F.window("ts", window).alias("w"))
    out = g.agg(F.count("*").alias("n"), F.avg("bikes").alias("bikes_mean"), F.min("bikes").alias("bikes_min"), F.max("bikes").alias("bikes_max"))
    return out.select("station_id", F.col("w.start").alias("start"), "n", "bikes_mean", "bikes_min", "bikes_max")
