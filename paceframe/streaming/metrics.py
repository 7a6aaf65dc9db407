"""Windowed metrics of a live stream; the same code runs on a bounded frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _measures() -> list[Column]:
    return [
        F.avg("power").alias("avg_power"),
        F.max("power").alias("max_power"),
        F.min("power").alias("min_power"),
        F.avg("heart_rate").alias("avg_heart_rate"),
        F.avg("speed").alias("avg_speed"),
        F.max("distance").alias("total_distance"),
    ]


def windowed_metrics(
    events: DataFrame, length: str = "5 minutes", slide: str | None = None, late_by: str | None = "10 minutes"
) -> DataFrame:
    """Power, heart rate, speed and distance per athlete and window (tumbling unless ``slide``).

    Partial aggregates combine before the shuffle, so a hot athlete costs one row per map
    task and window. ``late_by`` bounds the state of a stream; a batch ignores it.
    """
    timed = events.withWatermark("timestamp", late_by) if late_by else events
    window = F.window("timestamp", length, slide) if slide else F.window("timestamp", length)
    grouped = timed.groupBy("athlete_id", window.alias("window")).agg(*_measures())
    return _flat(grouped)


def session_metrics(events: DataFrame, gap: str = "30 minutes", late_by: str | None = "10 minutes") -> DataFrame:
    """The same measures per athlete and activity session, closed by a gap."""
    timed = events.withWatermark("timestamp", late_by) if late_by else events
    window = F.session_window("timestamp", gap)
    grouped = timed.groupBy("athlete_id", window.alias("window")).agg(F.count(F.lit(1)).alias("samples"), *_measures())
    return _flat(grouped)


def _flat(grouped: DataFrame) -> DataFrame:
    names = [c for c in grouped.columns if c not in ("athlete_id", "window")]
    return grouped.select(
        "athlete_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *names
    )
