"""Window functions, ranks, sorting and top-k over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceframe.config import DetectorConfig
from paceframe.operators import dedupe, rollups, sessions, stillness, timeseries
from paceframe.operators.skew import over_sessions
from paceframe.registry import CATALOGUE as C
from paceframe.registry import adapters as A
from paceframe.registry.adapters import with_views
from paceframe.registry.aggregates import canonical_samples


@C.add("E1_previous_point", with_views("""
    SELECT sample_id, round(lag(latitude) OVER s, 6) AS prev_latitude, round(lag(longitude) OVER s, 6) AS prev_longitude
    FROM running_samples WINDOW s AS (PARTITION BY athlete_id, session_id ORDER BY sample_id)""", "running_samples"))
def _(spark, sf):
    from paceframe.config import HotGroups

    found = over_sessions(
        A.running_samples(spark, sf), timeseries.SESSION, "sample_id", 1, timeseries.with_previous_point, HotGroups()
    )
    return found.select("sample_id", *[F.round(c, 6).alias(c) for c in ("prev_latitude", "prev_longitude")])


@C.add("E2_trailing_means", with_views("""
    SELECT sample_id, round(mean_speed, 6) AS mean_speed, round(mean_hr, 6) AS mean_heart_rate FROM features""", "features"))
def _(spark, sf):
    f = timeseries.session_features(A.running_samples(spark, sf))
    return f.select("sample_id", *[F.round(c, 6).alias(c) for c in ("mean_speed", "mean_heart_rate")])


@C.add("E3_session_baseline", with_views("""
    SELECT athlete_id, session_id, round(max(baseline), 9) AS baseline FROM drift GROUP BY 1, 2 HAVING max(baseline) IS NOT NULL
    """, "drift"))
def _(spark, sf):
    f = timeseries.session_features(A.running_samples(spark, sf))
    return timeseries.session_baseline(f).withColumn("baseline", F.round("baseline", 9))


@C.add("E4_drift_percent", with_views("""
    SELECT sample_id, round(drift_pct, 6) AS drift_pct FROM drift""", "drift"))
def _(spark, sf):
    f = timeseries.drifted_samples(A.running_samples(spark, sf))
    return f.select("sample_id", F.round("drift_pct", 6).alias("drift_pct"))


@C.add("E5_first_crisis", with_views("""
    SELECT athlete_id, session_id, sample_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS at,
           round(mean_speed, 6) AS mean_speed, round(drift_pct, 6) AS drift_pct FROM crisis""", "crisis"))
def _(spark, sf):
    found = timeseries.crisis_points(A.running_samples(spark, sf))
    return found.select(
        "athlete_id", "session_id", "sample_id", A.second(F.col("timestamp")).alias("at"),
        F.round("mean_speed", 6).alias("mean_speed"), F.round("drift_pct", 6).alias("drift_pct"),
    )


@C.add("E6_newest_per_key", with_views("""
    SELECT athlete_id, created_at, status, acwr FROM training_status
    QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY result_date DESC, created_at DESC) = 1""", "training_status"))
def _(spark, sf):
    found = dedupe.latest_per_key(A.training_status(spark, sf), ["athlete_id"], ["result_date", "created_at"])
    return found.select("athlete_id", "created_at", "status", "acwr")


@C.add("E7_position_in_batch", with_views("""
    SELECT sample_id, 100 + athlete_id + row_number() OVER (PARTITION BY athlete_id, session_id ORDER BY sample_id) - 1 AS sample_index
    FROM running_samples""", "running_samples"))
def _(spark, sf):
    s = A.running_samples(spark, sf).withColumn("base", F.col("athlete_id") + 100)
    return sessions.batch_position(s, timeseries.SESSION, "sample_id", "base").select("sample_id", "sample_index")


def stillness_sql(segment: str) -> str:
    """Alarms by a recursion over the samples of each segment, one sample per step."""
    moved = A.sql_haversine("a.alat", "a.alon", "s.lat", "s.lon")
    return f"""
    , seg AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, session_id, part ORDER BY sample_index) AS rn FROM ({segment})),
    RECURSIVE_STEP AS (
        SELECT athlete_id, session_id, part, rn, lat AS alat, lon AS alon, sample_index AS aidx, false AS alarmed, false AS fired,
               sample_index, 0::BIGINT AS still_for, lat, lon, bpm FROM seg WHERE rn = 1
        UNION ALL
        SELECT athlete_id, session_id, part, rn, CASE WHEN moved THEN lat ELSE alat END, CASE WHEN moved THEN lon ELSE alon END,
               CASE WHEN moved THEN sample_index ELSE aidx END, CASE WHEN moved THEN false ELSE alarmed OR hit END,
               NOT moved AND NOT alarmed AND hit, sample_index, sample_index - aidx, lat, lon, bpm
        FROM (SELECT s.athlete_id, s.session_id, s.part, s.rn, a.alat, a.alon, a.aidx, a.alarmed, s.sample_index, s.lat, s.lon, s.bpm,
                     {moved} > 10 AS moved, s.sample_index - a.aidx >= 30 AND s.bpm > 180 AS hit
              FROM RECURSIVE_STEP a JOIN seg s ON s.athlete_id = a.athlete_id AND s.session_id = a.session_id AND s.part = a.part
               AND s.rn = a.rn + 1))
    SELECT athlete_id, session_id, sample_index, still_for,
           format('Atleta {{}} fermo da {{}} s in posizione {{:.6f}}, {{:.6f}} (bpm {{:.0f}})', athlete_id, still_for, lat, lon, bpm) AS message
    FROM RECURSIVE_STEP WHERE fired"""


def recursive(sql: str) -> str:
    """Mark the list of views as recursive."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1).replace(")\n\n    , seg", "),\n    seg", 1)


@C.add("E8_stillness_alerts", recursive(with_views(stillness_sql("SELECT *, 0 AS part FROM hr_samples"), "hr_samples")))
def _(spark, sf):
    found = stillness.stillness_alerts(canonical_samples(spark, sf), DetectorConfig())
    return found.select("athlete_id", "session_id", "sample_index", "still_for", "message")


@C.add("E9_share_of_peak", """
    SELECT o_orderkey, CAST(greatest(6, floor(100 * (o_totalprice / (SELECT max(o_totalprice) FROM orders)) + 0.5::DOUBLE)) AS BIGINT) AS share_pct
    FROM orders""")
def _(spark, sf):
    return rollups.share_of_peak(A.table(spark, sf, "orders"), "o_totalprice", 6).select("o_orderkey", "share_pct")


@C.add("E10_min_max_scaled", """
    SELECT o_orderkey, o_orderpriority, round((o_totalprice - lo) / greatest(1.0::DOUBLE, hi - lo), 9) AS scaled
    FROM orders JOIN (SELECT o_orderpriority AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1) ON p = o_orderpriority""")
def _(spark, sf):
    found = rollups.min_max_scaled(
        A.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"]
    )
    return found.select("o_orderkey", "o_orderpriority", F.round("scaled", 9).alias("scaled"))


@C.add("F1_global_sort", with_views("""
    SELECT athlete_id, session_id, sample_id FROM running_samples ORDER BY 1, 2, 3""", "running_samples"))
def _(spark, sf):
    s = A.running_samples(spark, sf).select("athlete_id", "session_id", "sample_id")
    return s.orderBy("athlete_id", "session_id", "sample_id")


@C.add("F3_newest_days", with_views("""
    SELECT * FROM (SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM workout_plans GROUP BY 1 ORDER BY 1 DESC LIMIT 14)
    ORDER BY 1""", "workout_plans"))
def _(spark, sf):
    days = A.workout_plans(spark, sf).groupBy(F.to_date("created_at").cast("string").alias("day"))
    return days.agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("day").desc()).limit(14).orderBy("day")


@C.add("F4_first_in_key_order", """
    SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY 1, 2 LIMIT 10""")
def _(spark, sf):
    grouped = A.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return grouped.orderBy("l_suppkey", "l_linenumber").limit(10)


@C.add("F5_preview", """
    SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 5""")
def _(spark, sf):
    return A.table(spark, sf, "events").select("event_id", "user_id").orderBy("event_id").limit(5)


@C.add("F6_newest_first", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at FROM orders ORDER BY 2 DESC, 1 DESC""")
def _(spark, sf):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    rows = A.table(spark, sf, "orders").select("o_orderkey", iso.alias("created_at"))
    return rows.orderBy(F.col("created_at").desc(), F.col("o_orderkey").desc())
