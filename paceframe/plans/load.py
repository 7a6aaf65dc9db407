"""Comparison with all other athletes, and running volume that may be dangerous."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceframe.config import LoadConfig
from paceframe.functions.numbers import ratio
from paceframe.operators.ranking import population_rank


def athlete_means(samples: DataFrame) -> DataFrame:
    """Mean speed and heart rate per athlete."""
    return samples.groupBy(F.col("atleta_id").alias("athlete_id")).agg(
        F.round(F.avg("speed_kmh"), 6).alias("mean_speed_kmh"),
        F.round(F.avg("heart_rate_bpm"), 6).alias("mean_heart_rate"),
    )


def peer_performance(samples: DataFrame) -> DataFrame:
    """Each athlete's mean speed against the population (definition ours)."""
    return population_rank(athlete_means(samples), "mean_speed_kmh")


def load_ratio(loads: DataFrame, day: str, value: str, cfg: LoadConfig = LoadConfig()) -> DataFrame:
    """Acute load, chronic load, their ratio and a flag per athlete and training day (definition ours).

    Loads are summed per athlete and day first, so the range windows hold at most one row
    per day of an athlete's history.
    """
    daily = loads.groupBy("athlete_id", F.to_date(day).alias("day")).agg(F.sum(value).alias("load"))
    by_day = Window.partitionBy("athlete_id").orderBy("day_number")
    acute = F.sum("load").over(by_day.rangeBetween(-(cfg.acute_days - 1), 0))
    chronic = F.sum("load").over(by_day.rangeBetween(-(cfg.chronic_days - 1), 0)) * (cfg.acute_days / cfg.chronic_days)
    windows = daily.withColumn("day_number", F.datediff("day", F.lit("1970-01-01").cast("date")))
    rated = windows.select("athlete_id", "day", "load", acute.alias("acute"), chronic.alias("chronic"))
    r = F.round(ratio(F.col("acute"), F.col("chronic")), 6)
    flag = F.when(r > cfg.danger_ratio, "danger").when(r > cfg.caution_ratio, "caution").when(r.isNotNull(), "ok")
    return rated.select("*", r.alias("acwr"), flag.alias("flag"))
