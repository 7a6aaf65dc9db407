"""Joins of samples, sessions and dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceframe.functions.numbers import bmi
from paceframe.operators.dedupe import latest_per_key


def with_bmi(measurements: DataFrame) -> DataFrame:
    """Body measurements with their body mass index, pruned to the columns of the analysis."""
    return measurements.select(
        "athlete_id", "data_rilevazione", "peso_kg", "altezza_cm",
        bmi(F.col("peso_kg"), F.col("altezza_cm")).alias("bmi"),
    )


def join_same_day(sessions: DataFrame, measurements: DataFrame, at: str = "timestamp") -> DataFrame:
    """Sessions with the measurement taken on exactly their calendar day (inner)."""
    dated = sessions.withColumn("data_rilevazione", F.to_date(at))
    return dated.join(measurements, ["athlete_id", "data_rilevazione"])


def join_as_of(
    sessions: DataFrame, measurements: DataFrame, at: str, measured: str, key: str = "athlete_id"
) -> DataFrame:
    """Sessions with the latest measurement on or before their day (left).

    Not in the source system, which joins on the exact day. Both sides are first reduced to
    one row per key and calendar day, so the window over a key sees at most one row per day
    of history however many sessions the key has.
    """
    values = [c for c in measurements.columns if c not in (key, measured)]
    known = latest_per_key(
        measurements.select(key, F.to_date(measured).alias("_day"), F.struct(measured, *values).alias("_m")),
        [key, "_day"], ["_m"],
    )
    days = sessions.select(key, F.to_date(at).alias("_day")).distinct()
    axis = known.unionByName(days.withColumn("_m", F.lit(None)), allowMissingColumns=True)
    per_day = axis.groupBy(key, "_day").agg(F.max("_m").alias("_m"))
    so_far = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    filled = per_day.select(key, "_day", F.last("_m", ignorenulls=True).over(so_far).alias("_m"))
    joined = sessions.withColumn("_day", F.to_date(at)).join(filled, [key, "_day"], "left")
    return joined.select(*sessions.columns, F.col(f"_m.{measured}").alias(measured), *[f"_m.{c}" for c in values])


def new_rows_only(incoming: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the target yet, which makes a repeated load add nothing."""
    return incoming.join(target.select(key), key, "left_anti")


def accept_for_active(samples: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples of active sessions, rejects with a reason).

    A sample of an unknown session is ``session_not_found``, of an ended one ``session_not_active``.
    """
    states = sessions.select("session_id", F.col("status").alias("_status"))
    accepted = samples.join(states.filter(F.col("_status") == "active"), "session_id", "left_semi")
    rest = samples.join(states, "session_id", "left").filter(
        F.col("_status").isNull() | (F.col("_status") != "active")
    )
    reason = F.when(F.col("_status").isNull(), "session_not_found").otherwise("session_not_active")
    return accepted, rest.withColumn("reason", reason).drop("_status")


def with_latest(left: DataFrame, history: DataFrame, key: str, newest: Sequence[str]) -> DataFrame:
    """Left join to the newest history row of each key (a lateral top-1)."""
    return left.join(latest_per_key(history, [key], newest), key, "left")


def rows_at_maximum(df: DataFrame, column: str) -> DataFrame:
    """Rows holding the maximum of a column, by a scalar subquery."""
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def first_session_samples(samples: DataFrame, athlete_id: int) -> DataFrame:
    """All samples of one session of an athlete: the one with the smallest id."""
    own = F.col("athlete_id") == athlete_id
    wanted = samples.filter(own).agg(F.min("session_id")).scalar()
    return samples.filter(own & (F.col("session_id") == wanted))


def enrich_and_average(
    facts: DataFrame, dimension: DataFrame, key: str, by: Sequence[str], averages: dict[str, Column]
) -> DataFrame:
    """Join facts to a dimension (stream-static works too) and average the given expressions."""
    joined = facts.join(dimension, key)
    return joined.groupBy(*by).agg(*[F.avg(c).alias(name) for name, c in averages.items()])
