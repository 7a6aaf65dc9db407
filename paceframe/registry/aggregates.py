"""Aggregations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceframe.functions.dates import iso_week_id
from paceframe.operators import correlation, rollups, sessions
from paceframe.operators.wide_correlation import wide_correlation
from paceframe.operators.quality import canonical_events
from paceframe.plans import dashboard, training_status, workout_elt
from paceframe.plans.partials import DailyPartials
from paceframe.registry import CATALOGUE as C
from paceframe.registry import adapters as A
from paceframe.registry.adapters import with_views
from paceframe.runtime import scratch_path, written


@C.add("D2_athlete_days", with_views("""
    SELECT atleta, CAST(giorno AS VARCHAR) AS giorno, max_durata, round(media_velocita, 6) AS media_velocita,
           round(media_freq_cardiaca, 6) AS media_freq_cardiaca, round(max_distanza, 6) AS max_distanza,
           round(temperatura, 6) AS temperatura FROM endurance_days""", "endurance_days"))
def _(spark, sf):
    d = training_status.athlete_days(A.endurance_samples(spark, sf))
    rounded = [F.round(c, 6).alias(c) for c in ("media_velocita", "media_freq_cardiaca", "max_distanza", "temperatura")]
    return d.select("atleta", F.col("giorno").cast("string").alias("giorno"), "max_durata", *rounded)


@C.add("D3_mean_index_42_days", with_views("""
    SELECT atleta, round(avg(idx), 9) AS indice_allenamento_max FROM endurance_index
    WHERE max_distanza > 500 AND date_diff('day', giorno, DATE '2024-02-25') <= 42 GROUP BY atleta""", "endurance_index"))
def _(spark, sf):
    found = training_status.mean_index(A.endurance_samples(spark, sf), F.lit("2024-02-25").cast("date"))
    return found.select("atleta", F.round("indice_allenamento_max", 9).alias("indice_allenamento_max"))


@C.add("D4_index_per_day", with_views("""
    SELECT atleta, CAST(giorno AS VARCHAR) AS giorno, round(idx, 9) AS indice_allenamento FROM endurance_index
    WHERE max_distanza > 500""", "endurance_index"))
def _(spark, sf):
    found = training_status.index_per_day(A.endurance_samples(spark, sf))
    return found.select("atleta", F.col("giorno").cast("string").alias("giorno"), F.round("indice_allenamento", 9).alias("indice_allenamento"))


@C.add("D5_sessions_per_athlete", with_views("""
    SELECT athlete_id, count(DISTINCT session_id) AS numero_corse FROM running_samples GROUP BY 1""", "running_samples"))
def _(spark, sf):
    return rollups.sessions_per_athlete(A.running_samples(spark, sf))


WORDS = r"""
    SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+')) AS word FROM documents)
    WHERE word <> '' GROUP BY word"""


@C.add("D6_word_count", WORDS)
def _(spark, sf):
    return rollups.word_counts(A.table(spark, sf, "documents"), "text")


@C.add("D7_load_control", """
    SELECT count(*) AS to_process, min(l_orderkey) AS first_id, max(l_orderkey) AS last_id FROM lineitem""")
def _(spark, sf):
    return rollups.load_control(workout_elt.to_raw(A.workouts(spark, sf)))


@C.add("D8_reconciliation", with_views("""
    SELECT (SELECT count(*) FROM all_sets) AS expanded, (SELECT count(*) FROM good_sets) AS loaded,
           CASE WHEN (SELECT count(*) FROM all_sets) = (SELECT count(*) FROM good_sets) THEN 1 ELSE 0 END AS matches
    """, "good_sets"))
def _(spark, sf):
    raw = workout_elt.to_raw(A.workouts(spark, sf))
    counts = rollups.reconciliation(workout_elt.expand_sets(raw), workout_elt.workout_sets(raw)[0], ("expanded", "loaded"))
    return counts.withColumn("matches", F.col("matches").cast("int"))


@C.add("D9_split_chart", with_views("""
    SELECT CAST(secondo // 300 + 1 AS INTEGER) AS bucket, CAST(secondo // 300 + 1 AS INTEGER) AS km,
           round(avg(speed_kmh) * 0.0833333::DOUBLE, 3) AS distance_split, round(avg(heart_rate_bpm), 2) AS heart_rate
    FROM endurance_samples GROUP BY ALL""", "endurance_samples"))
def _(spark, sf):
    return rollups.split_chart(A.endurance_samples(spark, sf))


DAILY = """
    SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS inserts, round(avg(intensity), 2) AS avg_intensity,
           CAST(sum(target_load) AS BIGINT) AS total_target_load FROM workout_plans GROUP BY 1"""


@C.add("D10_daily_rollup", with_views(DAILY, "workout_plans"))
def _(spark, sf):
    return rollups.daily_plan_rollup(A.workout_plans(spark, sf)).withColumn("day", F.col("day").cast("string"))


def _corr_sql(a: str, b: str) -> str:
    return f"round(coalesce(corr({a}, {b}), 0), 6)"


def _dashboard_sql() -> str:
    rows = []
    for label, metric in correlation.DASHBOARD_METRICS.items():
        cells = [
            f"{'1.0::DOUBLE' if metric == column else _corr_sql(metric, column)} AS {name}"
            for name, column in correlation.DASHBOARD_COLUMNS.items()
        ]
        rows.append(f"SELECT '{label}' AS metric, {', '.join(cells)} FROM training_status")
    return " UNION ALL ".join(rows)


@C.add("D11_dashboard_correlations", with_views(_dashboard_sql(), "training_status"))
def _(spark, sf):
    found = correlation.dashboard_correlations(A.training_status(spark, sf))
    return found.select("metric", *[F.round(c, 6).alias(c) for c in correlation.DASHBOARD_COLUMNS])


LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _matrix_sql(source: str, columns: tuple[str, ...], with_n: bool) -> str:
    n = ", count(*) AS n" if with_n else ""
    cells = [
        f"SELECT '{x}' AS x, '{y}' AS y, {'1.0::DOUBLE' if x == y else f'round(corr({x}, {y}), 6)'} AS r{n} FROM {source} HAVING count(*) > 0"
        for x in columns for y in columns
    ]
    return " UNION ALL ".join(cells)


@C.add("D12_correlation_matrix", _matrix_sql("lineitem", LINE_COLUMNS, True))
def _(spark, sf):
    found = correlation.correlation_long(A.table(spark, sf, "lineitem"), LINE_COLUMNS)
    return found.withColumn("r", F.round("r", 6))


# Measures that are known for part of the rows only: each line column where each condition holds.
PART_CONDITIONS = {
    "all": "TRUE", "returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "few": "l_quantity < 25",
    "taxed": "l_tax > 0.02", "first": "l_linenumber <= 2", "late": "l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'", "cheap": "l_discount > 0.03",
}
PART_COLUMNS = {f"{c}_{name}": f"CASE WHEN {rule} THEN {c} END" for c in LINE_COLUMNS for name, rule in PART_CONDITIONS.items()}


def _pairwise_sql() -> str:
    names = list(PART_COLUMNS)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    cells = ", ".join(
        f"{{'x': '{a}', 'y': '{b}', 'r': CASE WHEN regr_sxx({a}, {b}) > 0 AND regr_syy({a}, {b}) > 0 THEN round(corr({a}, {b}), 6) END, 'n': regr_count({a}, {b})::BIGINT}}"
        for a, b in pairs
    )
    columns = ", ".join(f"{rule} AS {name}" for name, rule in PART_COLUMNS.items())
    return f"SELECT c.x AS x, c.y AS y, c.r AS r, c.n AS n FROM (SELECT unnest([{cells}]) AS c FROM (SELECT {columns} FROM lineitem))"


@C.add("D12_wide_correlation", _pairwise_sql())
def _(spark, sf):
    lines = A.table(spark, sf, "lineitem").select(*[F.expr(rule).alias(name) for name, rule in PART_COLUMNS.items()])
    return wide_correlation(lines, list(PART_COLUMNS)).select("x", "y", (F.round("r", 6) + 0.0).alias("r"), "n")


@C.add("J4_vector_correlation", _matrix_sql("lineitem", LINE_COLUMNS, False))
def _(spark, sf):
    found = correlation.correlation_vector(A.table(spark, sf, "lineitem"), LINE_COLUMNS)
    return found.withColumn("r", F.round("r", 6))


@C.add("D13_period_summary", with_views("""
    SELECT sum(total_trimp) AS total, CAST(floor(avg(total_trimp) + 0.5::DOUBLE) AS BIGINT) AS mean, max(total_trimp) AS max,
           min(total_trimp) AS min FROM weekly_cardio""", "weekly_cardio"))
def _(spark, sf):
    return rollups.period_summary(rollups.weekly_load(A.daily_loads(spark, sf), "day", "load"), "total_trimp")


@C.add("D14_status_counts", with_views("""
    SELECT count(*) AS total, count_if(s = 'green') AS green, count_if(s = 'amber') AS amber, count_if(s = 'red') AS red
    FROM (SELECT lower(coalesce(status, 'amber')) AS s FROM training_status)""", "training_status"))
def _(spark, sf):
    t = A.training_status(spark, sf)
    return rollups.status_counts(t.select(F.lower(F.coalesce("status", F.lit("amber"))).alias("status")))


@C.add("D15_weighted_mean", with_views("""
    SELECT CAST(sum(inserts) AS BIGINT) AS total_inserts,
           floor(sum(inserts * coalesce(avg_intensity, 0)) / sum(inserts) * 10 + 0.5::DOUBLE) / 10 AS avg_intensity,
           CAST(sum(total_target_load) AS BIGINT) AS total_load, max(inserts) AS peak_inserts
    FROM (""" + DAILY + ")", "workout_plans"))
def _(spark, sf):
    return rollups.weighted_summary(rollups.daily_plan_rollup(A.workout_plans(spark, sf)))


@C.add("D16_latency_report", with_views("""
    SELECT count(*) AS executed, count_if(success) AS succeeded, count_if(NOT success) AS failed,
           min(latency_ms) FILTER (success) AS latency_min, round(avg(latency_ms) FILTER (success), 2) AS latency_avg,
           max(latency_ms) FILTER (success) AS latency_max, round(count(*) / 60.0::DOUBLE, 2) AS requests_per_s,
           (SELECT latency_ms FROM request_log WHERE success ORDER BY latency_ms
            LIMIT 1 OFFSET (SELECT CAST(greatest(0, ceil(count(*) * 0.95::DOUBLE) - 1) AS BIGINT) FROM request_log WHERE success)) AS latency_p95
    FROM request_log""", "request_log"))
def _(spark, sf):
    return rollups.latency_report(A.request_log(spark, sf), 60.0)


@C.add("D16_first_failures", with_views("""
    SELECT request_id, status_code, latency_ms, error FROM request_log WHERE NOT success ORDER BY request_id LIMIT 10
    """, "request_log"))
def _(spark, sf):
    return rollups.first_failures(A.request_log(spark, sf))


@C.add("D17_high_water_mark", "SELECT coalesce(max(l_orderkey), 0) AS high_water_mark FROM lineitem")
def _(spark, sf):
    return rollups.high_water_mark(A.table(spark, sf, "lineitem"), "l_orderkey")


@C.add("D18_samples_sent", with_views("""
    SELECT s.session_id, s.status, s.samples_sent + coalesce(b.n, 0) AS samples_sent
    FROM smartwatch_sessions s LEFT JOIN (SELECT o_custkey + 1 AS id, CAST(sum(o_orderkey % 5) AS BIGINT) AS n FROM orders GROUP BY 1) b
    ON b.id = s.session_id""", "smartwatch_sessions"))
def _(spark, sf):
    batches = A.table(spark, sf, "orders").select(
        (F.col("o_custkey") + 1).alias("session_id"), (F.col("o_orderkey") % 5).alias("sent_count")
    )
    return sessions.samples_sent(A.smartwatch_sessions(spark, sf), batches)


def canonical_samples(spark, sf):
    """Valid samples and end markers of the JSON records, parsed once into a columnar archive."""
    from paceframe.streaming.ingest import heart_rate_events

    events, _ = heart_rate_events(A.event_json(A.table(spark, sf, "events")))
    return written(events, "sample-archive")


@C.add("D19_session_summary", with_views(f"""
    SELECT athlete_id, session_id, round(avg(speed), 6) AS velocita_media, round(max(speed), 6) AS velocita_max,
           round(avg(bpm), 6) AS frequenza_cardiaca_media, max(bpm) AS frequenza_cardiaca_max, round(avg(cadence), 6) AS cadenza_media,
           round(coalesce(sum(step), 0), 4) AS distanza_totale, count(*) AS campioni, count(*) * 5.0::DOUBLE AS durata_s
    FROM (SELECT *, step / nullif(gap, 0) AS speed FROM (
        SELECT *, {A.sql_haversine("lag(lat) OVER s", "lag(lon) OVER s", "lat", "lon")} AS step,
               sample_index - lag(sample_index) OVER s AS gap
        FROM hr_samples WINDOW s AS (PARTITION BY athlete_id, session_id ORDER BY sample_index)))
    GROUP BY athlete_id, session_id""", "hr_samples"))
def _(spark, sf):
    found = sessions.session_summary(canonical_samples(spark, sf))
    rounded = {"velocita_media": 6, "velocita_max": 6, "frequenza_cardiaca_media": 6, "cadenza_media": 6, "distanza_totale": 4}
    return found.withColumns({c: F.round(c, n) for c, n in rounded.items()})


@C.add("D20_session_lifecycle", with_views("""
    SELECT athlete_id, session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at,
           strftime(max(ts) FILTER (is_end), '%Y-%m-%d %H:%M:%S') AS ended_at,
           CASE WHEN bool_or(is_end) THEN 'ended' ELSE 'active' END AS status,
           CASE WHEN bool_or(is_end) THEN 'session_end' END AS end_reason, count_if(NOT is_end) AS samples_sent
    FROM hr_records WHERE is_end OR (NOT malformed AND bpm IS NOT NULL) GROUP BY 1, 2""", "hr_records"))
def _(spark, sf):
    events = canonical_samples(spark, sf).withColumn("timestamp", F.col("event_time"))
    found = sessions.session_lifecycle(events)
    return found.withColumns({c: A.second(F.col(c)) for c in ("started_at", "ended_at")})


@C.add("D21_weekly_load_after_correction", with_views("SELECT * FROM weekly_cardio", "weekly_cardio"))
def _(spark, sf):
    loads = A.daily_loads(spark, sf)
    table = DailyPartials(scratch_path(spark, "loads"), ["athlete_id"], "day", {"total_trimp": ("sum", "load")})
    # as it was before a correction: one week doubled, another missing
    week = F.to_date("day")
    wrong = loads.where(~week.between("1995-05-01", "1995-05-07")).withColumn("load", F.when(week.between("1995-03-06", "1995-03-12"), F.col("load") * 2).otherwise(F.col("load")))
    table.build(wrong)
    days = spark.sql("SELECT explode(concat(sequence(DATE'1995-03-06', DATE'1995-03-12'), sequence(DATE'1995-05-01', DATE'1995-05-07'))) AS day")
    table.refresh(loads, days)
    return table.merged(spark, "athlete_id", iso_week_id(F.col("day")).alias("week_id"))


@C.add("D21_weekly_load", with_views("SELECT * FROM weekly_cardio", "weekly_cardio"))
def _(spark, sf):
    return rollups.weekly_load(A.daily_loads(spark, sf), "day", "load")


@C.add("D22_time_in_zone", with_views("""
    SELECT athlete_id, session_id, CASE WHEN heart_rate < 120 THEN 'z1_recovery' WHEN heart_rate < 140 THEN 'z2_aerobic'
           WHEN heart_rate < 160 THEN 'z3_tempo' WHEN heart_rate < 175 THEN 'z4_threshold' ELSE 'z5_vo2max' END AS zone,
           count(*) AS samples, count(*) * 5.0::DOUBLE AS seconds
    FROM running_samples WHERE heart_rate IS NOT NULL GROUP BY 1, 2, 3""", "running_samples"))
def _(spark, sf):
    return rollups.time_in_zone(A.running_samples(spark, sf), 5.0)


@C.add("D23_force_plate", with_views("""
    SELECT athlete_id, exercise, round(avg(l + r), 6) AS mean_force, round(max(l + r), 6) AS peak_force,
           round(avg(100 * abs(l - r) / greatest(l, r)), 6) AS asymmetry_pct
    FROM force_plate GROUP BY 1, 2""", "force_plate"))
def _(spark, sf):
    found = rollups.force_plate_summary(A.force_plate(spark, sf))
    return found.select("athlete_id", "exercise", *[F.round(c, 6).alias(c) for c in ("mean_force", "peak_force", "asymmetry_pct")])


@C.add("D24_integer_range", "SELECT CAST(sum(event_id) AS BIGINT) AS total, count(*) AS n FROM events")
def _(spark, sf):
    return rollups.integer_range_check(A.table(spark, sf, "events").select(F.col("event_id").alias("id")))


@C.add("H27_null_on_empty", with_views("""
    SELECT athlete_code, round(avg(intensity), 6) AS mean, CAST(sum(target_load) AS BIGINT) AS total
    FROM workout_plans GROUP BY 1""", "workout_plans"))
def _(spark, sf):
    return A.workout_plans(spark, sf).groupBy("athlete_code").agg(
        F.round(F.avg("intensity"), 6).alias("mean"), F.sum("target_load").alias("total")
    )


@C.add("L11_running_chart", with_views("""
    SELECT CAST(secondo // 300 + 1 AS INTEGER) AS bucket, CAST(secondo // 300 + 1 AS INTEGER) AS km,
           round(avg(speed_kmh) * 0.0833333::DOUBLE, 3) AS distance_split, round(avg(heart_rate_bpm), 2) AS heart_rate
    FROM endurance_samples GROUP BY ALL ORDER BY bucket LIMIT 10""", "endurance_samples"))
def _(spark, sf):
    return dashboard.running_chart(A.endurance_samples(spark, sf))


@C.add("L11_training_volumes", with_views("""
    SELECT athlete_id, 'Lun' AS day, CAST(floor(total_trimp + 0.5::DOUBLE) AS BIGINT) AS load FROM weekly_cardio
    WHERE week_id = (SELECT max(week_id) FROM weekly_cardio) ORDER BY athlete_id LIMIT 7""", "weekly_cardio"))
def _(spark, sf):
    return dashboard.training_volumes(rollups.weekly_load(A.daily_loads(spark, sf), "day", "load"))


@C.add("L11_weekday_volumes", with_views("""
    SELECT CAST(dayofweek(day) AS INTEGER) AS dow, sum(load) AS load,
           ['Dom', 'Lun', 'Mar', 'Mer', 'Gio', 'Ven', 'Sab'][dayofweek(day) + 1] AS day
    FROM daily_loads AS t GROUP BY dayofweek(t.day)""".replace("dayofweek(day)", "dayofweek(t.day)"), "daily_loads"))
def _(spark, sf):
    return dashboard.weekday_volumes(A.daily_loads(spark, sf), "day", "load")


@C.add("L11_workouts_chart", with_views("SELECT * FROM (" + DAILY + " ORDER BY 1 DESC LIMIT 14)", "workout_plans"))
def _(spark, sf):
    return dashboard.workouts_chart(A.workout_plans(spark, sf)).withColumn("day", F.col("day").cast("string"))


@C.add("I6_malformed_split", with_views("""
    SELECT count_if(malformed) AS malformed, count_if(NOT malformed) AS kept FROM hr_records""", "hr_records"))
def _(spark, sf):
    events = canonical_events(A.event_json(A.table(spark, sf, "events")))
    return events.agg(F.count_if("malformed").alias("malformed"), F.count_if(~F.col("malformed")).alias("kept"))
