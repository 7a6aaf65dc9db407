"""Live samples against the life of their sessions: joins of streams with watermarks on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.streaming.sinks import read_files

ACCEPTED, UNKNOWN, ENDED = "accepted", "session_not_found", "session_not_active"


def admit(samples: DataFrame, starts: DataFrame, ends: DataFrame, longest: str = "24 hours", late_by: str = "10 minutes") -> DataFrame:
    """Samples with a ``decision``: accepted, or why not. A sample may be given twice, see below.

    ``samples`` has ``session_id`` and ``event_time``, ``starts`` and ``ends`` have ``session_id`` and ``at``. A session runs
    from its start until its end, at most for ``longest``. All three may come in any order within ``late_by``, and starts and
    ends more than once. A sample is accepted as soon as it and its session's start are there, and unknown once the watermark
    has passed it without one. A sample after its session's end is given as not active as soon as both are there, besides the
    row before; :func:`read_decided` makes one decision of them. The two joins stand side by side: in a chain the second
    would have to wait until nothing in the state of the first can match, that is for ``longest``.

    Starts and ends leave the state ``longest`` after their time, samples with the watermark. Session ids are not used again
    within ``longest``. A NULL id is an unknown session. Samples without a time must be taken out before, as
    :func:`paceframe.streaming.ingest.heart_rate_events` does.
    """
    timed = samples.withWatermark("event_time", late_by)
    begun = timed.join(_once(starts, late_by), _within(longest), "left")
    known = begun.select(*samples.columns, F.when(F.col("_at").isNull(), UNKNOWN).otherwise(ACCEPTED).alias("decision"))
    over = timed.join(_once(ends, late_by), _within(longest))
    return known.unionByName(over.select(*samples.columns, F.lit(ENDED).alias("decision")))


def _once(marks: DataFrame, late_by: str) -> DataFrame:
    """One start or end per session, however often it is delivered."""
    named = marks.select(F.col("session_id").alias("_session"), F.col("at").alias("_at"))
    return named.withWatermark("_at", late_by).dropDuplicatesWithinWatermark(["_session"])


def _within(longest: str) -> Column:
    at, time = F.col("_at"), F.col("event_time")
    return (F.col("session_id") == F.col("_session")) & (at <= time) & (time < at + F.expr(f"INTERVAL {longest}"))


def decided(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sample, which ``keys`` name, from the rows of :func:`admit`: an end outweighs acceptance.

    A sample whose session is not known yet has no row. Keys may be NULL.
    """
    first = rows.filter(F.col("decision") != ENDED)
    ended = rows.filter(F.col("decision") == ENDED).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    marked = first.join(ended.withColumn("_over", F.lit(True)), same, "left")
    decision = F.when(F.col("_over") & (F.col("decision") == ACCEPTED), ENDED).otherwise(F.col("decision"))
    return marked.select(*[c for c in rows.columns if c != "decision"], decision.alias("decision"))


def read_decided(spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str]) -> DataFrame:
    """The samples that :func:`paceframe.streaming.jobs.admission_job` has decided so far."""
    return decided(read_files(spark, path, schema), keys)
