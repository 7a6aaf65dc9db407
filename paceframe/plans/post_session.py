"""Analysis of one finished session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.config import DriftConfig
from paceframe.operators.rollups import time_in_zone
from paceframe.operators.timeseries import drifted_samples


def post_session(samples: DataFrame, athlete_id: int, session_id: int, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Samples, speed, heart rate, peak drift and seconds per zone of one session, as one row per zone.

    The key filter reaches the scan, so only that session's files and row groups are read.
    """
    own = samples.filter((F.col("athlete_id") == athlete_id) & (F.col("session_id") == session_id))
    features = drifted_samples(own, cfg)
    summary = features.groupBy("athlete_id", "session_id").agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.avg("speed_ms").alias("mean_speed"),
        F.max("speed_ms").alias("max_speed"),
        F.avg("heart_rate").alias("mean_heart_rate"),
        F.max("heart_rate").alias("max_heart_rate"),
        F.max("drift_pct").alias("max_drift_pct"),
    )
    zones = time_in_zone(features, cfg.sample_period_s)
    return zones.join(summary, ["athlete_id", "session_id"])
