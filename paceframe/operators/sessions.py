"""Session summaries and life cycles from a bounded set of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceframe.config import DetectorConfig
from paceframe.functions.geo import haversine_m
from paceframe.functions.numbers import ratio
from paceframe.operators.dedupe import first_per_key
from paceframe.operators.skew import dense_position, over_sessions

SESSION = ["athlete_id", "session_id"]


def unique_events(events: DataFrame) -> DataFrame:
    """Samples without redeliveries: one per (athlete, session, sample index), the earliest."""
    return first_per_key(events, [*SESSION, "sample_index"], ["timestamp"])


def session_summary(events: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Mean and maximum speed and heart rate, mean cadence, distance and samples per session.

    End markers are not samples. Distance is the sum over consecutive points and speed that
    distance over the index gap; a repeated index has no speed.
    """
    slim = events.filter(F.col("event_type") == "sample").select(
        *SESSION, "sample_index", "timestamp", "heart_rate_bpm", "cadence_spm", "latitude", "longitude"
    )

    def steps(frame: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("sample_index")
        before = [F.lag(c).over(w).alias(f"_prev_{c}") for c in ("latitude", "longitude", "sample_index")]
        step = haversine_m(F.col("_prev_latitude"), F.col("_prev_longitude"), F.col("latitude"), F.col("longitude"))
        gap = (F.col("sample_index") - F.col("_prev_sample_index")) * F.lit(cfg.seconds_per_index)
        return frame.select("*", *before).select("*", step.alias("_step"), gap.alias("_gap"))

    moved = over_sessions(slim, SESSION, "sample_index", 1, steps, cfg.hot, unique_events)
    speed = F.when(F.col("_gap") > 0, ratio(F.col("_step"), F.col("_gap")))
    n = F.count(F.lit(1))
    return moved.groupBy(*SESSION).agg(
        F.avg(speed).alias("velocita_media"),
        F.max(speed).alias("velocita_max"),
        F.avg("heart_rate_bpm").alias("frequenza_cardiaca_media"),
        F.max("heart_rate_bpm").alias("frequenza_cardiaca_max"),
        F.avg("cadence_spm").alias("cadenza_media"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("distanza_totale"),
        n.alias("campioni"),
        (n * F.lit(cfg.sample_period_s)).alias("durata_s"),
    )


def session_lifecycle(events: DataFrame) -> DataFrame:
    """Start, end, state and sample count of each session, from its events."""
    ended = F.col("event_type") == "session_end"
    at_end = F.max(F.when(ended, F.col("timestamp")))
    return events.groupBy(*SESSION).agg(
        F.min("timestamp").alias("started_at"),
        at_end.alias("ended_at"),
        F.when(F.bool_or(ended), "ended").otherwise("active").alias("status"),
        F.when(F.bool_or(ended), "session_end").alias("end_reason"),
        F.count_if(~ended).cast("bigint").alias("samples_sent"),
    )


def samples_sent(sessions: DataFrame, batches: DataFrame) -> DataFrame:
    """Sessions with ``samples_sent`` raised by the sizes of newly published batches."""
    added = batches.groupBy("session_id").agg(F.sum("sent_count").alias("_added"))
    joined = sessions.join(added, "session_id", "left")
    total = F.col("samples_sent") + F.coalesce(F.col("_added"), F.lit(0))
    return joined.withColumn("samples_sent", total.cast("bigint")).drop("_added")


def batch_position(samples: DataFrame, keys: list[str], axis: str, base: str | None = None) -> DataFrame:
    """0-based position within each key's batch (plus a base column), safe for hot keys."""
    placed = dense_position(samples, keys, axis, "position")
    return placed if base is None else placed.withColumn("sample_index", F.col(base) + F.col("position"))
