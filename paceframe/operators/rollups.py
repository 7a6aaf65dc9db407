"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe.functions.dates import iso_week_id
from paceframe.functions.numbers import heart_rate_zone, ratio, round_half_up
from paceframe.functions.text import words
from paceframe.operators.skew import group_key, value_counts_before


def group_means(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of several metrics per group, each named ``avg_<metric>``."""
    return df.groupBy(*by).agg(*[F.avg(m).alias(f"avg_{m}") for m in metrics])


def sessions_per_athlete(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct sessions per athlete; ``approximate`` uses a sketch instead of a second shuffle."""
    if approximate:
        n = F.approx_count_distinct("session_id")
        return df.groupBy("athlete_id").agg(n.alias("numero_corse"))
    # two-step: distinct pairs combine map-side, so a hot athlete does not reach one task
    pairs = df.select("athlete_id", "session_id").distinct()
    return pairs.groupBy("athlete_id").agg(F.count("session_id").alias("numero_corse"))


def word_counts(texts: DataFrame, column: str = "value") -> DataFrame:
    """Occurrences of each lower-cased word over the whole texts."""
    exploded = texts.select(F.explode(words(F.col(column))).alias("word")).filter(F.col("word") != "")
    return exploded.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def load_control(raw: DataFrame, key: str = "allenamento_id") -> DataFrame:
    """How many rows wait in staging, and the first and last id."""
    return raw.agg(
        F.count(F.lit(1)).alias("to_process"), F.min(key).alias("first_id"), F.max(key).alias("last_id")
    )


def high_water_mark(target: DataFrame, key: str) -> DataFrame:
    """Largest id loaded so far, 0 when there is none, as a one-row frame for scalar subqueries."""
    return target.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("high_water_mark"))


def reconciliation(expected: DataFrame, actual: DataFrame, names: Sequence[str] = ("expected", "actual")) -> DataFrame:
    """Row counts of two frames side by side and whether they agree."""
    counted = expected.agg(F.count(F.lit(1)).alias(names[0]))
    other = actual.agg(F.count(F.lit(1))).scalar()
    both = counted.withColumn(names[1], other)
    return both.withColumn("matches", F.col(names[0]) == F.col(names[1]))


def split_chart(samples: DataFrame, bucket_s: int = 300) -> DataFrame:
    """Per bucket of elapsed seconds: distance at mean speed and mean heart rate, over all sessions.

    ``km`` is the bucket number under the name the chart uses for it.
    """
    # Fixed value: hours per 300 s bucket, as rounded by the chart.
    hours = 0.0833333
    bucket = (F.floor(F.col("secondo") / F.lit(bucket_s)) + 1).cast("int")
    grouped = samples.groupBy(bucket.alias("bucket")).agg(
        F.round(F.avg("speed_kmh") * F.lit(hours), 3).alias("distance_split"),
        F.round(F.avg("heart_rate_bpm"), 2).alias("heart_rate"),
    )
    return grouped.withColumn("km", F.col("bucket"))


def daily_plan_rollup(plans: DataFrame) -> DataFrame:
    """Plans per day: count, mean intensity and total target load (NULL when no value is given)."""
    return plans.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("inserts"),
        F.round(F.avg("intensity"), 2).alias("avg_intensity"),
        F.sum("target_load").alias("total_target_load"),
    )


def period_summary(df: DataFrame, column: str) -> DataFrame:
    """Total, mean rounded to an integer, maximum and minimum; zeros (maximum 1) without rows."""
    x = F.col(column)
    empty = F.count(F.lit(1)) == 0
    return df.agg(
        F.when(empty, 0).otherwise(F.sum(x)).alias("total"),
        F.when(empty, 0).otherwise(round_half_up(F.avg(x))).alias("mean"),
        F.when(empty, 1).otherwise(F.max(x)).alias("max"),
        F.when(empty, 0).otherwise(F.min(x)).alias("min"),
    )


def status_counts(statuses: DataFrame) -> DataFrame:
    """Athletes by status."""
    return statuses.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("green", "amber", "red")],
    )


def weighted_summary(days: DataFrame) -> DataFrame:
    """Mean intensity weighted by the plans of each day, totals and the busiest day."""
    n = F.coalesce(F.col("inserts"), F.lit(0))
    weighted = F.sum(n * F.coalesce(F.col("avg_intensity"), F.lit(0.0)))
    mean = F.floor(ratio(weighted, F.sum(n)) * 10 + 0.5) / 10
    return days.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_inserts"),
        F.coalesce(mean, F.lit(0.0)).alias("avg_intensity"),
        F.coalesce(F.sum("total_target_load"), F.lit(0)).alias("total_load"),
        F.coalesce(F.max(n), F.lit(0)).alias("peak_inserts"),
    )


def nearest_rank(df: DataFrame, column: str, p: float) -> DataFrame:
    """Exact nearest-rank percentile as one row, without holding the values in one buffer.

    The smallest value up to which ``ceil(p * n)`` rows lie. Starts jobs.
    """
    counts = value_counts_before(df, column)
    total = df.agg(F.count(column)).scalar()
    wanted = F.greatest(F.lit(1), F.ceil(total * F.lit(p)))
    reached = counts.filter(F.col("before") + F.col("n") >= wanted)
    return reached.agg(F.min("value").alias("value"))


def latency_report(log: DataFrame, elapsed_s: Column | float, p: float = 0.95) -> DataFrame:
    """Requests executed, succeeded and failed; latency of the successes; requests per second."""
    ok = F.col("success")
    latency = F.when(ok, F.col("latency_ms"))
    elapsed = elapsed_s if isinstance(elapsed_s, Column) else F.lit(float(elapsed_s))
    n = F.count(F.lit(1))
    p95 = nearest_rank(log.filter(ok), "latency_ms", p).scalar()
    summary = log.agg(
        n.alias("executed"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.min(latency), F.lit(0.0)).alias("latency_min"),
        F.coalesce(F.round(F.avg(latency), 2), F.lit(0.0)).alias("latency_avg"),
        F.coalesce(F.max(latency), F.lit(0.0)).alias("latency_max"),
        F.round(F.coalesce(F.when(elapsed > 0, ratio(n, elapsed)), F.lit(0.0)), 2).alias("requests_per_s"),
    )
    return summary.withColumn("latency_p95", F.coalesce(p95, F.lit(0.0)))


def first_failures(log: DataFrame, n: int = 10) -> DataFrame:
    """The first failed requests (the limit is the report)."""
    failed = log.filter(~F.col("success"))
    return failed.select("request_id", "status_code", "latency_ms", "error").orderBy("request_id").limit(n)


def weekly_load(loads: DataFrame, day: str, value: str) -> DataFrame:
    """Total load per athlete and ISO week."""
    week = iso_week_id(F.to_date(day)).alias("week_id")
    return loads.groupBy("athlete_id", week).agg(F.sum(value).alias("total_trimp"))


def time_in_zone(samples: DataFrame, period_s: float, by: Sequence[str] = ("athlete_id", "session_id")) -> DataFrame:
    """Seconds per session in each heart-rate zone."""
    zone = heart_rate_zone(F.col("heart_rate")).alias("zone")
    known = samples.filter(F.col("heart_rate").isNotNull())
    return known.groupBy(*by, zone).agg(
        F.count(F.lit(1)).alias("samples"), (F.count(F.lit(1)) * F.lit(period_s)).alias("seconds")
    )


def force_plate_summary(samples: DataFrame) -> DataFrame:
    """Mean and peak total force and left/right asymmetry per athlete and exercise (definition ours)."""
    left, right = F.col("left_foot_force_newtons"), F.col("right_foot_force_newtons")
    asymmetry = ratio(F.abs(left - right), F.greatest(left, right)) * 100
    total = F.coalesce(F.col("total_force_newtons"), left + right)
    return samples.groupBy("athlete_id", "exercise").agg(
        F.avg(total).alias("mean_force"), F.max(total).alias("peak_force"), F.avg(asymmetry).alias("asymmetry_pct")
    )


def share_of_peak(df: DataFrame, column: str, floor: int | None = None) -> DataFrame:
    """Whole percent of the column's maximum, optionally not below ``floor``.

    The maximum is a scalar subquery, not a window over the whole frame, which would put
    every row in one task.
    """
    peak = df.agg(F.max(column)).scalar()
    share = round_half_up(ratio(F.col(column), peak) * 100)
    if floor is not None:
        share = F.greatest(F.lit(floor), F.coalesce(share, F.lit(floor)))
    return df.withColumn("share_pct", share)


def min_max_scaled(df: DataFrame, column: str, series: Sequence[str]) -> DataFrame:
    """(x - min) / max(1, max - min) within each series; limits come from a combining aggregate."""
    keyed = df.withColumn("_g", group_key(series))
    limits = keyed.groupBy("_g").agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    spread = F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo")).cast("double"))
    scaled = ((F.col(column) - F.col("_lo")) / spread).alias("scaled")
    return keyed.join(limits, "_g").select(*df.columns, scaled)


def integer_range_check(df_range: DataFrame) -> DataFrame:
    """Sum and count of an id range, the cluster sanity check."""
    return df_range.agg(F.sum("id").alias("total"), F.count("id").alias("n"))
