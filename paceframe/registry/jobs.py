"""The user-facing jobs over the driver tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from paceframe.plans import exercises, load, population, post_session, text, training_status, workout_elt
from paceframe.registry import CATALOGUE as C
from paceframe.registry import adapters as A
from paceframe.registry.adapters import with_views
from paceframe.registry.aggregates import WORDS
from paceframe.runtime import scratch_path


@C.add("L1_population_points", with_views("""
    SELECT athlete_id, session_id, sample_id, round(mean_speed, 6) AS mean_speed, round(drift_pct, 6) AS drift_pct, peso_kg, altezza_cm,
           round(bmi, 6) AS bmi, numero_corse FROM population""", "population"))
def population_points(spark, sf):
    """Flagship: crisis points with body measurements."""
    found = population.population_points(A.running_samples(spark, sf), A.anthropometric(spark, sf))
    return found.select(
        "athlete_id", "session_id", "sample_id", F.round("mean_speed", 6).alias("mean_speed"),
        F.round("drift_pct", 6).alias("drift_pct"), "peso_kg", "altezza_cm", F.round("bmi", 6).alias("bmi"), "numero_corse",
    )


def _matrix() -> str:
    rows = [
        f"SELECT '{x}' AS x, '{y}' AS y, "
        + ("1.0::DOUBLE" if x == y else f"round(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 6)")
        + " AS r, count(*) AS n FROM population HAVING count(*) > 0"
        for x, y in product(population.ANALYSED, population.ANALYSED)
    ]
    return " UNION ALL ".join(rows)


@C.add("L1_population_correlation", with_views(_matrix(), "population").replace("population AS (", "population AS MATERIALIZED ("))
def _(spark, sf):
    found = population.population_correlation(A.running_samples(spark, sf), A.anthropometric(spark, sf))
    return found.withColumn("r", F.round("r", 6))


@C.add("L2_workout_sets", with_views("""
    SELECT allenamento_id, athlete_id, CAST(CAST(data_allenamento AS DATE) AS VARCHAR) AS day, nome AS nome_esercizio,
           CAST(serie AS INTEGER) AS serie_allenamento, CAST(ripetizioni AS INTEGER) AS ripetizioni_allenamento,
           CAST(recupero AS INTEGER) AS recupero_allenamento, CAST(carico AS DOUBLE) AS peso_allenamento
    FROM good_sets""", "good_sets"))
def _(spark, sf):
    sets, _ = workout_elt.workout_sets(workout_elt.to_raw(A.workouts(spark, sf)))
    return sets.select(
        "allenamento_id", "athlete_id", F.to_date("data_allenamento").cast("string").alias("day"), "nome_esercizio",
        "serie_allenamento", "ripetizioni_allenamento", "recupero_allenamento",
        F.col("peso_allenamento").cast("double").alias("peso_allenamento"),
    )


@C.add("L2_quarantined_sets", with_views("""
    SELECT allenamento_id, nome, serie, concat_ws(',', CASE WHEN recupero > 255 THEN 'recupero_range' END,
             CASE WHEN abs(carico) > 999.99 THEN 'carico_range' END) AS reasons
    FROM all_sets WHERE recupero > 255 OR abs(carico) > 999.99
    UNION ALL
    SELECT l_orderkey, NULL, NULL, 'document_unreadable' FROM lineitem WHERE l_orderkey % 53 = 0 AND l_orderkey % 50 <> 0 AND l_orderkey % 51 <> 0
    """, "all_sets"))
def _(spark, sf):
    _, rejected = workout_elt.workout_sets(workout_elt.to_raw(A.workouts(spark, sf)))
    return rejected.select("allenamento_id", "nome", "serie", F.array_join("reasons", ",").alias("reasons"))


@C.add("L2_load_run", with_views("""
    SELECT count(*) AS to_process, min(l_orderkey) AS first_id, max(l_orderkey) AS last_id,
           (SELECT count(*) FROM good_sets) AS sets_written, 0::BIGINT AS left_in_staging
    FROM lineitem WHERE l_orderkey > 0""", "good_sets"))
def _(spark, sf):
    base = scratch_path(spark, "workout-load")
    paths = workout_elt.LoadPaths(f"{base}/staging", f"{base}/target", f"{base}/quarantine")
    return workout_elt.run_load(A.workouts(spark, sf), paths)


@C.add("L3_training_status", with_views("""
    SELECT d.atleta, CAST(d.giorno AS VARCHAR) AS giorno, round(d.idx, 9) AS indice_allenamento, m.mean_index
    FROM endurance_index d LEFT JOIN (
        SELECT atleta, round(avg(idx), 9) AS mean_index FROM endurance_index
        WHERE max_distanza > 500 AND date_diff('day', giorno, DATE '2024-02-25') <= 42 GROUP BY atleta) m ON m.atleta = d.atleta
    WHERE d.max_distanza > 500""", "endurance_index"))
def _(spark, sf):
    samples = A.endurance_samples(spark, sf)
    mean = training_status.mean_index(samples, F.lit("2024-02-25").cast("date"))
    days = training_status.index_per_day(samples).join(mean, "atleta", "left")
    return days.select(
        "atleta", F.col("giorno").cast("string").alias("giorno"), F.round("indice_allenamento", 9).alias("indice_allenamento"),
        F.round("indice_allenamento_max", 9).alias("mean_index"),
    )


@C.add("L4_exercise_correlations", with_views("", "good_sets").rstrip() + """, daily AS MATERIALIZED (
        SELECT athlete_id, CAST(data_allenamento AS DATE) AS day, nome, avg(CAST(carico AS DOUBLE)) AS load FROM good_sets GROUP BY ALL
    ), own AS (SELECT DISTINCT athlete_id, nome FROM daily WHERE load IS NOT NULL),
    days AS (SELECT athlete_id, count(DISTINCT day) AS rows FROM daily GROUP BY 1),
    related AS (
        SELECT athlete_id, a.nome AS x, b.nome AS y, round(covar_pop(a.load, b.load) / nullif(stddev_pop(a.load) * stddev_pop(b.load), 0), 6) AS r
        FROM daily a JOIN daily b USING (athlete_id, day) GROUP BY ALL
    )
    SELECT o.athlete_id, o.nome AS x, p.nome AS y, CASE WHEN o.nome = p.nome THEN 1.0::DOUBLE ELSE r END AS r, rows
    FROM own o JOIN own p USING (athlete_id) JOIN days USING (athlete_id)
    LEFT JOIN related ON related.athlete_id = o.athlete_id AND related.x = o.nome AND related.y = p.nome""")
def _(spark, sf):
    sets, _ = workout_elt.workout_sets(workout_elt.to_raw(A.workouts(spark, sf)))
    return exercises.exercise_correlations(sets).withColumn("r", F.round("r", 6))


@C.add("L5_peer_performance", with_views("""
    SELECT athlete_id, mean_speed_kmh, mean_heart_rate, round(percent_rank() OVER (ORDER BY mean_speed_kmh), 9) AS percent_rank,
           CAST(least(100, floor(percent_rank() OVER (ORDER BY mean_speed_kmh) * 100) + 1) AS INTEGER) AS percentile,
           round((mean_speed_kmh - avg(mean_speed_kmh) OVER ()) / nullif(stddev_pop(mean_speed_kmh) OVER (), 0), 6) AS z_score
    FROM (SELECT atleta_id AS athlete_id, round(avg(speed_kmh), 6) AS mean_speed_kmh, round(avg(heart_rate_bpm), 6) AS mean_heart_rate
          FROM endurance_samples GROUP BY 1)""", "endurance_samples"))
def _(spark, sf):
    found = load.peer_performance(A.endurance_samples(spark, sf))
    return found.withColumns({"percent_rank": F.round("percent_rank", 9), "z_score": F.round("z_score", 6)})


@C.add("L6_load_ratio", with_views("""
    SELECT athlete_id, CAST(day AS VARCHAR) AS day, load, acute, acwr,
           CASE WHEN acwr > 1.5 THEN 'danger' WHEN acwr > 1.3 THEN 'caution' WHEN acwr IS NOT NULL THEN 'ok' END AS flag
    FROM (SELECT athlete_id, day, load, acute, round(acute / nullif(chronic / 4, 0), 6) AS acwr FROM (
        SELECT *, sum(load) OVER (PARTITION BY athlete_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS acute,
               sum(load) OVER (PARTITION BY athlete_id ORDER BY day RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW) AS chronic
        FROM (SELECT athlete_id, CAST(day AS DATE) AS day, sum(load) AS load FROM daily_loads GROUP BY 1, 2)))""", "daily_loads"))
def _(spark, sf):
    found = load.load_ratio(A.daily_loads(spark, sf), "day", "load")
    return found.select("athlete_id", F.col("day").cast("string").alias("day"), "load", "acute", "acwr", "flag")


@C.add("L7_post_session", with_views("""
    SELECT z.*, s.total_samples, s.mean_speed, s.max_speed, s.mean_heart_rate, s.max_heart_rate, s.max_drift_pct FROM (
        SELECT athlete_id, session_id, CASE WHEN heart_rate < 120 THEN 'z1_recovery' WHEN heart_rate < 140 THEN 'z2_aerobic'
               WHEN heart_rate < 160 THEN 'z3_tempo' WHEN heart_rate < 175 THEN 'z4_threshold' ELSE 'z5_vo2max' END AS zone,
               count(*) AS samples, count(*) * 5.0::DOUBLE AS seconds
        FROM clean_samples GROUP BY 1, 2, 3) z
    JOIN (SELECT athlete_id, session_id, count(*) AS total_samples, round(avg(speed), 6) AS mean_speed, round(max(speed), 6) AS max_speed,
                 round(avg(heart_rate), 6) AS mean_heart_rate, max(heart_rate) AS max_heart_rate, round(max(drift_pct), 6) AS max_drift_pct
          FROM drift GROUP BY 1, 2) s ON s.athlete_id = z.athlete_id AND s.session_id = z.session_id
    WHERE z.athlete_id = 9 AND z.session_id = 1""", "drift"))
def _(spark, sf):
    found = post_session.post_session(A.running_samples(spark, sf), 9, 1)
    return found.withColumns({c: F.round(c, 6) for c in ("mean_speed", "max_speed", "mean_heart_rate", "max_drift_pct")})


@C.add("L12_word_count_report", WORDS + " ORDER BY 2 DESC, 1")
def _(spark, sf):
    return text.word_count_report(A.table(spark, sf, "documents"), "text")
