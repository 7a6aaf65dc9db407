"""Per-session time series: speed, rolling means, efficiency, cardiac drift, crisis points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.config import DriftConfig
from paceframe.functions.geo import haversine_m
from paceframe.functions.numbers import ratio
from paceframe.operators.dedupe import first_per_key
from paceframe.operators.quality import all_present
from paceframe.operators.skew import chunk_with_halo, dense_position, over_sessions, split_hot

SESSION = ["athlete_id", "session_id"]
REQUIRED = ["athlete_id", "session_id", "sample_id", "heart_rate", "latitude", "longitude", "timestamp"]


def unique_samples(samples: DataFrame) -> DataFrame:
    """One row per (athlete, session, sample): the earliest, then the smallest remaining values."""
    return first_per_key(samples, [*SESSION, "sample_id"], ["timestamp"])


def _keyed(samples: DataFrame) -> DataFrame:
    """Rows with a session and a sample number; the others never pass the quality rule, so they are not shuffled."""
    return samples.select(*REQUIRED).filter(all_present([*SESSION, "sample_id"]))


def _clean(samples: DataFrame) -> DataFrame:
    return unique_samples(samples).filter(all_present(REQUIRED))


def with_previous_point(df: DataFrame, by: list[str], order: str = "sample_id") -> DataFrame:
    """Add the previous latitude and longitude within the session."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.select(
        "*", F.lag("latitude", 1).over(w).alias("prev_latitude"), F.lag("longitude", 1).over(w).alias("prev_longitude")
    )


def trailing_mean(df: DataFrame, column: str, name: str, w: WindowSpec, n_prev: int) -> DataFrame:
    """Add the mean of the current and the ``n_prev`` rows before it.

    Spark adds up every row of a sliding frame again for each row. For whole numbers the
    same mean comes exactly from running totals at constant cost per row; other numbers keep
    the frame, because differences of running totals would round.
    """
    if not isinstance(df.schema[column].dataType, T.IntegralType) or n_prev < 4:
        return df.select("*", F.avg(column).over(w.rowsBetween(-n_prev, Window.currentRow)).alias(name))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.coalesce(F.sum(column).over(so_far), F.lit(0))
    totals = df.select("*", total.alias("_sum"), F.count(column).over(so_far).alias("_n"))
    gone = [F.lag(c, n_prev + 1, 0).over(w).alias(f"_old{c}") for c in ("_sum", "_n")]
    differences = totals.select("*", *gone)
    mean = ratio(F.col("_sum") - F.col("_old_sum"), F.col("_n") - F.col("_old_n"))
    return differences.withColumn(name, mean).drop("_sum", "_n", "_old_sum", "_old_n")


def _efficiency(df: DataFrame, by: list[str], cfg: DriftConfig) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("sample_id")
    step = haversine_m(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude"))
    moved = with_previous_point(df, by).select("*", (step / F.lit(cfg.sample_period_s)).alias("speed_ms"))
    smooth = trailing_mean(moved, "speed_ms", "mean_speed", w, cfg.n_prev)
    smooth = trailing_mean(smooth, "heart_rate", "mean_heart_rate", w, cfg.n_prev)
    return smooth.select("*", ratio(F.col("speed_ms"), F.col("mean_heart_rate")).alias("efficiency"))


def session_features(samples: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Clean samples with speed, trailing means and efficiency (speed over mean heart rate).

    Rows lacking a required field go after the choice among duplicates. Ordinary sessions
    cost one exchange: dedupe, lag and both frames share its partitioning and one sort.
    """
    # the frame needs n_prev earlier rows, and the first of these its own predecessor
    return over_sessions(
        _keyed(samples), SESSION, "sample_id", cfg.n_prev + 1, lambda f, by: _efficiency(f, by, cfg), cfg.hot, _clean
    ).drop("prev_latitude", "prev_longitude")


def session_baseline(features: DataFrame) -> DataFrame:
    """First non-NULL efficiency of each session, as an aggregate that combines map-side."""
    present = features.filter(F.col("efficiency").isNotNull())
    return present.groupBy(*SESSION).agg(F.min_by("efficiency", "sample_id").alias("baseline"))


def with_drift(features: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Add the percentage change of efficiency against the column ``baseline``."""
    change = ratio(F.col("efficiency") - F.col("baseline"), F.col("baseline")) * 100
    return features.withColumn("drift_pct", F.round(change, cfg.drift_decimals))


def drifted_samples(samples: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Session features with the session's baseline and the drift against it.

    The baseline is the first non-NULL efficiency: the first row of a session has no
    previous point, so its efficiency is NULL and cannot be the reference value.

    Ordinary sessions read the baseline with ``first(ignorenulls)`` over the frame that is
    already sorted, so nothing is shuffled again. A piece of a hot session does not see the
    session's start; its baseline is a partial aggregate joined back by broadcast (one row
    per hot session, at most rows / max_rows of them).
    """
    ordinary, big = split_hot(_keyed(samples), SESSION, cfg.hot.max_rows)
    w = Window.partitionBy(*SESSION).orderBy("sample_id")
    plain = _efficiency(_clean(ordinary.repartition(*SESSION)), SESSION, cfg)
    plain = plain.select("*", F.first("efficiency", ignorenulls=True).over(w).alias("baseline"))

    cut = chunk_with_halo(dense_position(_clean(big), SESSION, "sample_id"), cfg.hot.chunk_rows, cfg.n_prev + 1)
    pieces = _efficiency(cut, [*SESSION, "_chunk"], cfg).filter(~F.col("_halo"))
    pieces = pieces.join(F.broadcast(session_baseline(pieces)), SESSION, "left")
    both = plain.unionByName(pieces.select(*plain.columns))
    return with_drift(both, cfg).drop("prev_latitude", "prev_longitude")


def crisis_points(samples: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Earliest sample of each session whose drift exceeds the threshold (strictly).

    The minimum of a struct led by time combines map-side; no window over the session is sorted again.
    """
    first = F.min(F.struct("timestamp", "sample_id", "mean_speed", "drift_pct")).alias("first")
    found = drifted_samples(samples, cfg).filter(F.col("drift_pct") > cfg.crisis_pct).groupBy(*SESSION).agg(first)
    return found.select(*SESSION, "first.timestamp", "first.sample_id", "first.mean_speed", "first.drift_pct")
