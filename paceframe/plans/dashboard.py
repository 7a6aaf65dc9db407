"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.functions.dates import iso_week_monday, weekday_name, weekday_number
from paceframe.functions.numbers import parse_integer, parse_number, round_half_up
from paceframe.functions.text import athlete_code, first_positive_int, full_name
from paceframe.operators.joins import rows_at_maximum, with_latest
from paceframe.operators.rollups import daily_plan_rollup, split_chart


def recommendation(status):
    """Next session by status."""
    # Texts shown to the athlete.
    return (
        F.when(status == "red", "Recupero attivo")
        .when(status == "amber", "Carico controllato")
        .otherwise("Sessione progressiva")
    )


def training_status(athletes: DataFrame, history: DataFrame) -> DataFrame:
    """Every athlete with the newest status, amber when there is none, and a recommendation."""
    newest = with_latest(
        athletes.select("athlete_id", "nome", "cognome"),
        history.select("athlete_id", "result_date", "created_at", "status", "acwr", "readiness"),
        "athlete_id",
        ["result_date", "created_at"],
    )
    status = F.lower(F.coalesce(F.col("status"), F.lit("amber")))
    return newest.select(
        "athlete_id",
        athlete_code(F.col("athlete_id")).alias("id"),
        full_name(F.col("nome"), F.col("cognome")).alias("name"),
        status.alias("status"),
        F.coalesce(F.col("acwr"), F.lit(0.0)).alias("acwr"),
        F.coalesce(F.col("readiness").cast("int"), F.lit(0)).alias("readiness"),
        recommendation(status).alias("next_session"),
    )


def training_volumes(weekly: DataFrame, limit: int = 7) -> DataFrame:
    """The first athletes of the latest week. The day is that week's Monday for every row."""
    latest = rows_at_maximum(weekly, "week_id")
    dow = weekday_number(iso_week_monday(F.col("week_id")))
    return (
        latest.select(
            "athlete_id", weekday_name(dow).alias("day"), round_half_up(F.col("total_trimp")).cast("bigint").alias("load")
        )
        .orderBy("athlete_id")
        .limit(limit)
    )


def weekday_volumes(loads: DataFrame, day: str, value: str) -> DataFrame:
    """Total load by true weekday (ours: the chart above always shows Monday)."""
    dow = weekday_number(F.to_date(day))
    totals = loads.groupBy(dow.alias("dow")).agg(F.sum(value).alias("load"))
    return totals.withColumn("day", weekday_name(F.col("dow")))


def running_chart(samples: DataFrame, limit: int = 10) -> DataFrame:
    """The first buckets of the split chart."""
    return split_chart(samples).orderBy("bucket").limit(limit)


def workouts_chart(plans: DataFrame, limit: int = 14) -> DataFrame:
    """The newest days with plans, oldest first."""
    return daily_plan_rollup(plans).orderBy(F.col("day").desc()).limit(limit).orderBy("day")


def single_plans(requests: DataFrame) -> DataFrame:
    """Workout plans from submitted forms: athlete number out of its code, numbers or NULL."""
    return requests.select(
        F.col("athlete").alias("athlete_code"),
        first_positive_int(F.col("athlete")).alias("athlete_id"),
        F.col("session_type"),
        parse_integer(F.col("duration_min")).alias("duration_min"),
        parse_integer(F.col("intensity")).alias("intensity"),
        "notes",
    )


def weekly_plans(requests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Weekly plans with defaults and the estimated daily load; columns in ``keep`` are carried along."""
    # Defaults of missing fields.
    load = parse_number(F.col("target_load"), 3200.0)
    load = F.when(load == 0, F.lit(3200.0)).otherwise(load)

    def default(column: str, value: str):
        return F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit(value)).otherwise(F.col(column))

    code = default("athlete", "AT-002")
    return requests.select(
        *keep,
        code.alias("athlete_code"),
        first_positive_int(code).alias("athlete_id"),
        F.lit("weekly-plan").alias("session_type"),
        default("phase", "Costruzione").alias("phase"),
        load.alias("target_load"),
        default("focus", "Tolleranza lattato").alias("focus"),
        round_half_up(load / 7).cast("bigint").alias("estimated_daily_load"),
    )
