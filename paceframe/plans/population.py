"""Running-population analysis: crisis points, body measurements and their correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.config import DriftConfig
from paceframe.operators.correlation import correlation_long
from paceframe.operators.joins import join_same_day, with_bmi
from paceframe.operators.timeseries import crisis_points
from paceframe.runtime import written

# Columns of the correlation matrix.
ANALYSED = ("peso_kg", "altezza_cm", "bmi", "mean_speed", "numero_corse")


def population_points(samples: DataFrame, measurements: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """First crisis point of each session with the same-day measurement and the athlete's run count.

    Starts a job: the crisis points feed two joins, so they are written once to the shared
    folder instead of running the session windows twice. ``numero_corse`` counts sessions
    that have a crisis point.
    """
    crisis = written(crisis_points(samples, cfg), "crisis-points")
    runs = crisis.groupBy("athlete_id").agg(F.count("session_id").alias("numero_corse"))
    return join_same_day(crisis, with_bmi(measurements)).join(runs, "athlete_id", "left")


def population_correlation(samples: DataFrame, measurements: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Pearson matrix over the population, as rows (x, y, r, n); empty without matches."""
    return correlation_long(population_points(samples, measurements, cfg), ANALYSED)
