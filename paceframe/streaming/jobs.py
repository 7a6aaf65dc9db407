"""The live jobs: detector, windowed metrics, workout events and the raw sample archive."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paceframe.config import DetectorConfig
from paceframe.functions.dates import month_number
from paceframe.schemas import METRICS_EVENT, WORKOUT_EVENT
from paceframe.streaming import sinks
from paceframe.streaming.admission import admit
from paceframe.streaming.detector import detect
from paceframe.streaming.ingest import decode_strict, heart_rate_events, without_redelivery
from paceframe.streaming.metrics import windowed_metrics

#: Events of one micro-batch that a bucket and a task of the detector get, about.
BUCKET_EVENTS, TASK_EVENTS = 25_000, 200_000


def for_backlog(spark: SparkSession, cfg: DetectorConfig, events: int) -> tuple[DetectorConfig, int]:
    """(parameters, state partitions) of a detector whose micro-batch may bring ``events`` at once, as a first start without caps does.

    A worker holds a bucket's events as records and gives the new states of all its task's buckets back together, so both
    numbers follow the events: a worker's memory does not. Never fewer than the given buckets or one partition per core.
    """
    partitions = max(spark.sparkContext.defaultParallelism, -(-events // TASK_EVENTS))
    return replace(cfg, buckets=max(cfg.buckets, -(-events // BUCKET_EVENTS))), partitions


def detector_job(
    records: DataFrame, alerts: str, summaries: str, cfg: DetectorConfig = DetectorConfig(),
    checkpoint: str | None = None, interval: str | None = None, late_by: str = "10 minutes",
    state_partitions: int | None = None, in_order: bool = False,
) -> StreamingQuery:
    """Broker records -> canonical events -> alarms and session summaries, at once or ``in_order`` of event time.

    All jobs run until stopped when given an ``interval``, else to the end of what is there;
    ``state_partitions`` is fixed in the checkpoint by the first start.
    """
    events, _ = heart_rate_events(records)
    writer = sinks.detector_sink(alerts, summaries)
    return sinks.start(detect(events, cfg, late_by, in_order), writer, "detector", checkpoint, interval, state_partitions)


def dead_letter_job(records: DataFrame, path: str, checkpoint: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Records the detector cannot use, with reasons."""
    _, dead = heart_rate_events(records)
    return sinks.start(dead, sinks.parquet_sink(path), "dead-letters", checkpoint, interval)


ARCHIVE = (
    "athlete_id string, session_id bigint, sample_index bigint, latitude double, longitude double, heart_rate_bpm double, "
    "cadence_spm double, event_type string, event_time timestamp, ym int"
)


def archive_job(
    records: DataFrame, path: str, checkpoint: str | None = None, interval: str | None = None, state_partitions: int | None = None,
    late_by: str = "10 minutes",
) -> StreamingQuery:
    """Raw samples in bulk, without redeliveries, by month, the layout of the recorded samples.

    Runs from its own query and checkpoint; each batch lands once. Read it with :func:`sinks.read_files` and ``ARCHIVE``; a filter
    on ``ym`` reads only those months.
    """
    events, _ = heart_rate_events(records)
    kinds = dict(part.split() for part in ARCHIVE.split(", "))
    by_month = without_redelivery(events, late_by).withColumn("ym", month_number(F.col("event_time")))
    samples = by_month.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    return sinks.start_files(samples, path, ["ym"], "archive", checkpoint, interval, state_partitions)


def metrics_job(
    records: DataFrame, path: str, checkpoint: str | None = None, length: str = "5 minutes", late_by: str = "10 minutes",
    interval: str | None = None, state_partitions: int | None = None,
) -> StreamingQuery:
    """Metric records -> windowed metrics; a window is written once it can no longer change."""
    events, _ = decode_strict(records, METRICS_EVENT)
    grouped = windowed_metrics(events, length, late_by=late_by)
    return sinks.start(grouped, sinks.parquet_sink(path), "metrics", checkpoint, interval, state_partitions)


def workouts_job(
    records: DataFrame, writer: sinks.BatchWriter, checkpoint: str | None = None, interval: str | None = None
) -> StreamingQuery:
    """Workout records -> relational store (or any batch writer)."""
    events, _ = decode_strict(records, WORKOUT_EVENT)
    return sinks.start(events, writer, "workout-events", checkpoint, interval)


def admission_job(
    samples: DataFrame, starts: DataFrame, ends: DataFrame, path: str, checkpoint: str | None = None, longest: str = "24 hours",
    late_by: str = "10 minutes", interval: str | None = None, state_partitions: int | None = None,
) -> StreamingQuery:
    """Samples and their sessions' starts and ends -> one table by ``decision``, for :func:`paceframe.streaming.admission.read_decided`."""
    decided = admit(samples, starts, ends, longest, late_by)
    return sinks.start_files(decided, path, ["decision"], "admission", checkpoint, interval, state_partitions)


def staging_job(growing: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """A table that grows by ids (:func:`paceframe.sources.marked.marked_stream`) -> staging, each increment once."""
    return sinks.start_files(growing, path, [], "staging", checkpoint, interval)
