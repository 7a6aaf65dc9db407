"""Correlations between the loads of an athlete's exercises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.functions.numbers import safe_corr
from paceframe.runtime import written


def daily_loads(sets: DataFrame) -> DataFrame:
    """Mean load per athlete, day and exercise; the shuffle carries partial sums, not sets."""
    load = F.col("peso_allenamento").cast("double")
    day = F.to_date("data_allenamento").alias("day")
    return sets.groupBy("athlete_id", day, F.col("nome_esercizio").alias("exercise")).agg(F.avg(load).alias("load"))


def exercise_correlations(sets: DataFrame) -> DataFrame:
    """The square matrix of each athlete's exercises in long form: (athlete_id, x, y, r, rows).

    The exercises are those found in the data, any number of them. Pairs use the days with
    both (definition ours); an undefined pair is NULL, an exercise with itself 1; ``rows``
    counts the athlete's training days. A day is one row with its different exercises, and pairs
    are made within it, so their number is bounded by what an athlete trains on one day.
    Starts a job: the days feed three aggregations and are written once.
    """
    one = F.struct("exercise", "load")
    days = daily_loads(sets).groupBy("athlete_id", "day").agg(F.collect_list(F.when(F.col("load").isNotNull(), one)).alias("loads"))
    days = written(days, "daily-loads")
    x = days.select("athlete_id", "loads", F.explode("loads").alias("x"))
    pairs = x.select("athlete_id", "x", F.explode("loads").alias("y")).filter(F.col("x.exercise") < F.col("y.exercise"))
    named = pairs.select("athlete_id", F.col("x.exercise").alias("x"), F.col("y.exercise").alias("y"), F.col("x.load").alias("load_x"), F.col("y.load").alias("load_y"))
    related = named.groupBy("athlete_id", "x", "y").agg(safe_corr(F.col("load_x"), F.col("load_y")).alias("r"))
    both = related.unionByName(related.select("athlete_id", F.col("y").alias("x"), F.col("x").alias("y"), "r"))
    own = x.select("athlete_id", F.col("x.exercise").alias("x")).distinct()
    grid = own.join(own.withColumnRenamed("x", "y"), "athlete_id").join(both, ["athlete_id", "x", "y"], "left")
    r = F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(F.col("r")).alias("r")
    counts = days.groupBy("athlete_id").agg(F.count(F.lit(1)).alias("rows"))
    return grid.join(counts, "athlete_id").select("athlete_id", "x", "y", r, "rows")
