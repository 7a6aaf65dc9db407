"""Streaming jobs: the driver tables read as file streams, processed to the end, sinks read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceframe.config import DetectorConfig
from paceframe.operators.timeseries import SESSION
from paceframe.registry import CATALOGUE as C
from paceframe.registry import adapters as A
from paceframe.registry.adapters import sql_haversine, with_views
from paceframe.registry.windows import recursive, stillness_sql
from paceframe.runtime import scratch_path
from paceframe.schemas import METRICS_EVENT, WORKOUT_EVENT
from paceframe.sources.marked import marked_stream
from paceframe.streaming import jobs, sinks
from paceframe.streaming.admission import read_decided
from paceframe.streaming.ingest import decode, decode_strict, heart_rate_events, without_redelivery
from paceframe.streaming.metrics import session_metrics, windowed_metrics


def _finish(spark, df, name, writer=sinks.parquet_sink):
    """Run a stream to the end into a fresh sink and read the sink."""
    path = scratch_path(spark, name)
    sinks.run_available(df, writer(path), name)
    return sinks.read_sink(spark, path, df.schema)


@C.add("I1_decoded_stream", with_views("""
    SELECT athlete_id, count(*) AS n, round(avg(power), 6) AS power, max(heart_rate) AS heart_rate FROM metric_events GROUP BY 1
    """, "metric_events"))
def _(spark, sf):
    rows = decode(A.metric_json(A.stream(spark, sf, "events")), METRICS_EVENT).filter(F.col("workout_id").isNotNull())
    back = _finish(spark, rows, "decoded")
    return back.groupBy(F.col("athlete_id").cast("bigint").alias("athlete_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("power"), 6).alias("power"), F.max("heart_rate").alias("heart_rate")
    )


CLOSED = "WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM metric_events)"
MEASURES = """round(avg(power), 6) AS avg_power, max(power) AS max_power, min(power) AS min_power,
           round(avg(heart_rate), 6) AS avg_heart_rate, round(avg(speed), 6) AS avg_speed, max(distance) AS total_distance"""
NAMES = "avg_power, max_power, min_power, avg_heart_rate, avg_speed, total_distance"


def _shown(metrics):
    return metrics.select(
        F.col("athlete_id").cast("bigint").alias("athlete_id"),
        A.second(F.col("window_start")).alias("window_start"), A.second(F.col("window_end")).alias("window_end"),
        *[F.round(F.col(c).cast("double"), 6).alias(c) for c in NAMES.split(", ") if c in metrics.columns],
    )


def _window_sql(start: str, length: str, source: str = "metric_events") -> str:
    return f"""
    SELECT athlete_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, {NAMES}
    FROM (SELECT athlete_id, {start} AS window_start, {start} + INTERVAL {length} AS window_end, {MEASURES} FROM {source} GROUP BY 1, 2, 3) {CLOSED}"""


def _metric_events(spark, sf):
    return decode_strict(A.metric_json(A.stream(spark, sf, "events")), METRICS_EVENT)[0]


@C.add("I2_tumbling_windows", with_views(_window_sql("time_bucket(INTERVAL 5 MINUTES, ts)", "5 MINUTES"), "metric_events"))
def _(spark, sf):
    return _shown(_finish(spark, windowed_metrics(_metric_events(spark, sf)), "tumbling"))


@C.add("I14_sliding_windows", with_views(_window_sql(
    "window_start", "1 HOUR",
    "(SELECT *, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS window_start FROM metric_events)",
), "metric_events"))
def _(spark, sf):
    return _shown(_finish(spark, windowed_metrics(_metric_events(spark, sf), "1 hour", "30 minutes"), "sliding"))


@C.add("I14_session_windows", with_views(f"""
    SELECT athlete_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start,
           strftime(max(ts) + INTERVAL 4 HOURS, '%Y-%m-%d %H:%M:%S') AS window_end, {MEASURES}
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY athlete_id ORDER BY ts) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY athlete_id ORDER BY ts) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS fresh FROM metric_events))
    GROUP BY athlete_id, s HAVING max(ts) + INTERVAL 4 HOURS <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM metric_events)""", "metric_events"))
def _(spark, sf):
    return _shown(_finish(spark, session_metrics(_metric_events(spark, sf), "4 hours"), "sessions"))


def _for_events(spark, sf, cfg):
    """The detector's settings for the whole table in one micro-batch; the count reads file footers."""
    return jobs.for_backlog(spark, cfg, A.table(spark, sf, "events").count())


def _detected(spark, sf):
    alerts, summaries = scratch_path(spark, "alerts"), scratch_path(spark, "summaries")
    cfg, partitions = _for_events(spark, sf, DetectorConfig())
    jobs.detector_job(A.event_json(A.stream(spark, sf, "events")), alerts, summaries, cfg, state_partitions=partitions).awaitTermination()
    return alerts, summaries


SEGMENTS = """SELECT *, coalesce(sum(CAST(is_end AS INTEGER)) OVER (PARTITION BY athlete_id, session_id ORDER BY sample_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM hr_records WHERE is_end OR (NOT malformed AND bpm IS NOT NULL)"""


@C.add("L8_detector_alerts", recursive(with_views(stillness_sql(f"SELECT * FROM ({SEGMENTS}) WHERE NOT is_end"), "hr_records")))
def _(spark, sf):
    alerts, _ = _detected(spark, sf)
    schema = "athlete_id string, session_id bigint, sample_index bigint, still_for bigint, message string"
    return sinks.read_sink(spark, alerts, schema)


@C.add("L8_session_summaries", with_views(f"""
    SELECT athlete_id, session_id, round(avg(speed), 6) AS velocita_media, round(max(speed), 6) AS velocita_max,
           round(avg(bpm), 6) AS frequenza_cardiaca_media, max(bpm) AS frequenza_cardiaca_max, round(avg(cadence), 6) AS cadenza_media,
           round(coalesce(sum(step), 0), 4) AS distanza_totale, count_if(NOT is_end) AS campioni,
           CASE WHEN bool_or(is_end) THEN 'session_end' ELSE 'timeout' END AS end_reason
    FROM (SELECT athlete_id, session_id, part, is_end, ts, step, step / nullif(gap, 0) AS speed,
                 CASE WHEN NOT is_end THEN bpm END AS bpm, CASE WHEN NOT is_end THEN cadence END AS cadence FROM (
        SELECT *, CASE WHEN NOT is_end THEN {sql_haversine("lag(lat) OVER s", "lag(lon) OVER s", "lat", "lon")} END AS step,
               sample_index - lag(sample_index) OVER s AS gap
        FROM ({SEGMENTS}) WINDOW s AS (PARTITION BY athlete_id, session_id, part ORDER BY sample_index)))
    GROUP BY athlete_id, session_id, part
    HAVING bool_or(is_end) OR max(ts) + INTERVAL 2 HOURS <=
        (SELECT max(ts) - INTERVAL 10 MINUTES FROM hr_records WHERE is_end OR (NOT malformed AND bpm IS NOT NULL))""", "hr_records"))
def _(spark, sf):
    _, summaries = _detected(spark, sf)
    schema = (
        "athlete_id string, session_id bigint, velocita_media double, velocita_max double, frequenza_cardiaca_media double, "
        "frequenza_cardiaca_max double, cadenza_media double, distanza_totale double, campioni bigint, end_reason string"
    )
    found = sinks.read_sink(spark, summaries, schema)
    rounded = {"velocita_media": 6, "velocita_max": 6, "frequenza_cardiaca_media": 6, "cadenza_media": 6, "distanza_totale": 4}
    return found.withColumns({c: F.round(c, n) for c, n in rounded.items()})


BEHIND, IDLE = "6 DAYS", "12 HOURS"


@C.add("L8_summaries_in_any_order", with_views(f"""
    SELECT athlete_id, session_id, round(avg(speed), 6) AS velocita_media, round(max(speed), 6) AS velocita_max,
           round(avg(bpm), 6) AS frequenza_cardiaca_media, max(bpm) AS frequenza_cardiaca_max, round(coalesce(sum(step), 0), 4) AS distanza_totale,
           count_if(NOT is_end) AS campioni, CASE WHEN bool_or(is_end) THEN 'session_end' ELSE 'timeout' END AS end_reason
    FROM (SELECT athlete_id, session_id, part, is_end, ts, step, step / nullif(gap, 0) AS speed, CASE WHEN NOT is_end THEN bpm END AS bpm FROM (
        SELECT *, CASE WHEN NOT is_end THEN {sql_haversine("lag(lat) OVER s", "lag(lon) OVER s", "lat", "lon")} END AS step,
               sample_index - lag(sample_index) OVER s AS gap
        FROM (SELECT *, sum(begins) OVER (PARTITION BY athlete_id, session_id ORDER BY ts, sample_index) AS part FROM (
            SELECT *, CASE WHEN lag(is_end) OVER w OR ts - lag(ts) OVER w >= INTERVAL {IDLE} THEN 1 ELSE 0 END AS begins
            FROM hr_records WHERE is_end OR (NOT malformed AND bpm IS NOT NULL) WINDOW w AS (PARTITION BY athlete_id, session_id ORDER BY ts, sample_index)))
        WINDOW s AS (PARTITION BY athlete_id, session_id, part ORDER BY sample_index)))
    GROUP BY athlete_id, session_id, part
    HAVING max(ts) FILTER (is_end) < (SELECT max(ts) - INTERVAL {BEHIND} FROM hr_records WHERE is_end OR (NOT malformed AND bpm IS NOT NULL))
        OR max(ts) FILTER (NOT is_end) + INTERVAL {IDLE} <= (SELECT max(ts) - INTERVAL {BEHIND} FROM hr_records WHERE is_end OR (NOT malformed AND bpm IS NOT NULL))
    """, "hr_records"))
def _(spark, sf):
    alerts, summaries = scratch_path(spark, "alerts"), scratch_path(spark, "summaries")
    cfg, partitions = _for_events(spark, sf, DetectorConfig(idle_timeout=IDLE))
    records = A.shuffled_records(spark, sf)
    jobs.detector_job(records, alerts, summaries, cfg, late_by=BEHIND, state_partitions=partitions, in_order=True).awaitTermination()
    schema = (
        "athlete_id string, session_id bigint, velocita_media double, velocita_max double, frequenza_cardiaca_media double, "
        "frequenza_cardiaca_max double, distanza_totale double, campioni bigint, end_reason string"
    )
    found = sinks.read_sink(spark, summaries, schema)
    rounded = {"velocita_media": 6, "velocita_max": 6, "frequenza_cardiaca_media": 6, "distanza_totale": 4}
    return found.withColumns({c: F.round(c, n) for c, n in rounded.items()})


@C.add("I6_dead_letters", with_views("""
    SELECT count(*) AS n, CASE WHEN malformed THEN 'malformed' ELSE 'heart_rate_missing' END AS reason
    FROM hr_records WHERE malformed OR (NOT is_end AND bpm IS NULL) GROUP BY 2""", "hr_records"))
def _(spark, sf):
    path = scratch_path(spark, "dead")
    jobs.dead_letter_job(A.event_json(A.stream(spark, sf, "events")), path).awaitTermination()
    back = sinks.read_sink(spark, path, "raw string, reasons array<string>")
    return back.groupBy(F.element_at("reasons", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@C.add("I7_sample_archive", with_views("""
    SELECT athlete_id, session_id, sample_index, CASE WHEN is_end THEN 'session_end' ELSE 'sample' END AS event_type,
           CASE WHEN NOT is_end THEN bpm END AS heart_rate_bpm
    FROM hr_records WHERE is_end OR (NOT malformed AND bpm IS NOT NULL)""", "hr_records"))
def _(spark, sf):
    path = scratch_path(spark, "archive")
    jobs.archive_job(A.event_json(A.stream(spark, sf, "events")), path).awaitTermination()
    return sinks.read_files(spark, path, jobs.ARCHIVE).select("athlete_id", "session_id", "sample_index", "event_type", "heart_rate_bpm")


@C.add("A10_archive_replayed_by_month", with_views("""
    SELECT CAST(year(ts) * 100 + month(ts) AS INTEGER) AS ym, athlete_id, count(*) AS n, max(bpm) FILTER (NOT is_end) AS max_bpm
    FROM hr_records WHERE is_end OR (NOT malformed AND bpm IS NOT NULL) GROUP BY 1, 2
    """, "hr_records"))
def _(spark, sf):
    path, checkpoint = scratch_path(spark, "archive"), scratch_path(spark, "archive-checkpoint")
    records = A.event_json(A.stream(spark, sf, "events"))
    jobs.archive_job(records, path, checkpoint).awaitTermination()
    sinks.forget_commits(spark, checkpoint)  # as after a crash before the commit: the batch runs again
    jobs.archive_job(records, path, checkpoint).awaitTermination()
    archived = sinks.read_files(spark, path, jobs.ARCHIVE)
    bpm = F.when(F.col("event_type") == "sample", F.col("heart_rate_bpm"))
    return archived.groupBy("ym", "athlete_id").agg(F.count(F.lit(1)).alias("n"), F.max(bpm).alias("max_bpm"))


@C.add("I13_streaming_dedupe", with_views("""
    SELECT athlete_id, session_id, count(*) AS n FROM hr_records WHERE is_end OR (NOT malformed AND bpm IS NOT NULL) GROUP BY 1, 2
    """, "hr_records"))
def _(spark, sf):
    once, again = A.stream(spark, sf, "events"), A.stream(spark, sf, "events")
    events, _ = heart_rate_events(A.event_json(once.unionByName(again)))
    back = _finish(spark, without_redelivery(events).select(*SESSION), "dedupe")
    return back.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n"))


@C.add("L9_metrics_job", with_views(_window_sql("time_bucket(INTERVAL 5 MINUTES, ts)", "5 MINUTES"), "metric_events"))
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    jobs.metrics_job(A.metric_json(A.stream(spark, sf, "events")), path).awaitTermination()
    schema = (
        "athlete_id int, window_start timestamp, window_end timestamp, avg_power double, max_power float, min_power float, "
        "avg_heart_rate double, avg_speed double, total_distance float"
    )
    return _shown(sinks.read_sink(spark, path, schema))


@C.add("L10_workout_events", """
    SELECT CAST(o_custkey AS INTEGER) AS athlete_id, CAST(o_orderkey AS INTEGER) AS workout_id, strftime(o_orderdate, '%Y-%m-%d') AS date,
           CAST(o_orderkey % 120 AS INTEGER) AS duration_minutes, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'cancelled' END AS status
    FROM orders""")
def _(spark, sf):
    path = scratch_path(spark, "workouts")
    jobs.workouts_job(A.workout_json(A.stream(spark, sf, "orders")), sinks.parquet_sink(path)).awaitTermination()
    return sinks.read_sink(spark, path, WORKOUT_EVENT)


@C.add("A8_json_batch_sink", """
    SELECT o_custkey AS athlete_id, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "json-batches")
    rows = decode(A.workout_json(A.stream(spark, sf, "orders")), WORKOUT_EVENT)
    sinks.run_available(rows, sinks.json_sink(path), "json-batches")
    back = spark.read.schema(WORKOUT_EVENT).option("recursiveFileLookup", "true").json(path)
    return back.groupBy(F.col("athlete_id").cast("bigint").alias("athlete_id")).agg(F.count(F.lit(1)).alias("n"))


@C.add("A18_streaming_upsert", """
    SELECT o_custkey AS athlete_id, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "upserts")
    rows = A.stream(spark, sf, "orders").select(
        F.col("o_custkey").alias("athlete_id"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("value")
    )
    sinks.run_available(rows, sinks.upsert_sink(path, ["athlete_id"], "version"), "upserts")
    return sinks.read_upserted(spark, path, rows.schema, ["athlete_id"], ["version"])


@C.add("C12_live_admission", """
    WITH samples AS (SELECT event_id, user_id AS session_id, date_trunc('microsecond', ts) AS ts FROM events),
    started AS (SELECT c_custkey AS session_id, DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) AS day FROM customer WHERE c_custkey % 7 <> 0),
    ended AS (SELECT c_custkey AS session_id, DATE '2024-01-01' + CAST(c_custkey % 28 + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 5 END AS INTEGER) AS day
              FROM customer WHERE c_custkey % 3 = 0),
    passed AS (SELECT least((SELECT max(ts) FROM samples), (SELECT max(day) FROM started), (SELECT max(day) FROM ended)) - INTERVAL 1 DAY AS mark)
    SELECT event_id, s.session_id, CASE WHEN b.day IS NULL THEN 'session_not_found' WHEN e.day IS NOT NULL THEN 'session_not_active' ELSE 'accepted' END AS decision
    FROM samples s LEFT JOIN started b ON b.session_id = s.session_id AND b.day <= ts AND ts < b.day + INTERVAL 12 DAYS
    LEFT JOIN ended e ON e.session_id = s.session_id AND e.day <= ts AND ts < e.day + INTERVAL 12 DAYS
    WHERE ts < (SELECT mark FROM passed) OR b.day IS NOT NULL""")
def _(spark, sf):
    path = scratch_path(spark, "admission")
    people = A.stream(spark, sf, "customer")
    jobs.admission_job(
        A.live_samples(A.stream(spark, sf, "events")), A.session_marks(people, False), A.session_marks(people, True), path,
        longest="12 DAYS", late_by="1 DAY",
    ).awaitTermination()
    found = read_decided(spark, path, "event_id bigint, session_id bigint, event_time timestamp, decision string", ["event_id"])
    return found.drop("event_time")


@C.add("A6_continuous_staging", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders""")
def _(spark, sf):
    path, checkpoint, grown = (scratch_path(spark, n) for n in ("staging", "staging-checkpoint", "growing"))
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    wanted = "o_orderkey bigint, o_custkey bigint, o_totalprice double"
    newest = orders.agg(F.max("o_orderkey")).scalar()
    third = F.floor(F.least(F.lit(2), F.col("o_orderkey") * 3 / newest))
    for part in range(3):  # the table grows between runs of the job
        orders.filter(third == part).write.mode("append").parquet(grown)
        jobs.staging_job(marked_stream(spark, grown, wanted, "o_orderkey"), path, checkpoint).awaitTermination()
    sinks.forget_commits(spark, checkpoint)  # as after a crash before the commit
    jobs.staging_job(marked_stream(spark, grown, wanted, "o_orderkey"), path, checkpoint).awaitTermination()
    return sinks.read_files(spark, path, wanted)
