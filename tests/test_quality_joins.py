import json

from conftest import rows
from pyspark.sql import functions as F

from paceframe.functions.documents import compact_json
from paceframe.operators import dedupe, joins, quality, rollups
from paceframe.plans import dashboard, load, training_status
from paceframe.streaming.ingest import heart_rate_events

A = {"athlete_id": "1", "session_id": 5, "heart_rate_bpm": 150.5, "cadence_spm": 170, "altitude_m": 3, "sample_index": 4,
     "latitude": 42.9, "longitude": 12.7, "timestamp": "2024-01-01T00:00:00Z"}
B = {"atleta_id": 2, "sessione_id": "6", "heart_rate": 160, "cadence": 171, "altitude": 3, "sample_id": 9, "event_type": "sample",
     "timestamp": "2024-01-01T00:00:05Z", "extra": {"x": 1}}


def records(spark, *values):
    return spark.createDataFrame([(v if v is None or isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def test_dialects_become_one(spark):
    good, dead = heart_rate_events(records(
        spark, A, B, {**A, "event_type": "end", "heart_rate_bpm": None}, {**A, "heart_rate_bpm": "high"}, {**A, "heart_rate_bpm": None},
        '{"athlete_id":', "", None, "[1]", {**A, "timestamp": "soon"}, {**A, "session_id": "x"},
    ))
    assert rows(good, "athlete_id", "session_id", "sample_index", "heart_rate_bpm", "event_type") == [
        ("1", 5, 4, 150.5, "sample"), ("1", 5, 4, None, "session_end"), ("2", 6, 9, 160.0, "sample")]
    reasons = sorted(tuple(r.reasons) for r in dead.collect())
    assert [r[0] for r in reasons].count("malformed") == 4
    assert ("timestamp_missing",) in reasons and ("session_id_missing",) in reasons
    assert reasons.count(("heart_rate_missing",)) == 2


def test_valid_and_quarantine_are_a_partition(spark):
    df = spark.createDataFrame([(1, "150"), (2, None), (3, "NaN"), (4, "x"), (5, "1e400")], "i int, heart_rate_bpm string")
    for c in ("cadence_spm", "speed_kmh", "altitude_m"):
        df = df.withColumn(c, F.lit("1"))
    good, bad = quality.split_valid(df, quality.sample_rules())
    assert rows(good, "i") == [(1,)]
    assert rows(bad, "i", "reasons") == [(i, ["heart_rate_bpm_not_numeric"]) for i in (2, 3, 4, 5)]


def test_domain_bounds_are_exclusive(spark):
    df = spark.createDataFrame([(50, 75.0), (51, 75.0), (299, 10.0), (300, 499.0), (None, 75.0)], "altezza_cm int, peso_kg double")
    found = [r.reasons for r in quality.with_reasons(df, quality.anthropometric_rules()).collect()]
    assert found == [["altezza_cm_range"], [], ["peso_kg_range"], ["altezza_cm_range"], ["altezza_cm_range"]]


def test_square_matrix(spark):
    df = spark.createDataFrame([
        (["a", "b"], [[1.0, 0.0], [0.0, 1.0]]), (["a"], [[1.0]]), (["a", "b"], [[1.0, 0.0]]), (["a", "b"], [[1.0], [0.0, 1.0]]), (None, None),
    ], "columns array<string>, matrix array<array<double>>")
    assert [r[0] for r in df.select(quality.square_matrix_rule()).collect()] == [True, False, False, False, False]


def test_enriched_defaults(spark):
    df = spark.createDataFrame(
        [("1", 5, "150", "x", "3", "4", None, None, "2024", None, None, 2), ("1", 5, "150", "1", "3", "4", "NaN", "9", "2024", "s", "bike", 3)],
        "athlete_id string, session_id int, heart_rate_bpm string, cadence_spm string, speed_kmh string, altitude_m string, "
        "temperature_c string, sample_index string, timestamp string, source string, sport string, position int")
    got = quality.enrich_samples(df, F.lit(100)).select("cadence_spm", "temperature_c", "sample_index", "source", "sport").collect()
    assert [tuple(r) for r in got] == [(None, 20.0, 102, "frontend-sim", "running_endurance"), (1.0, 20.0, 9, "s", "bike")]


def test_first_and_latest_per_key_are_deterministic(spark):
    data = [(1, 3, "b"), (1, 3, "a"), (1, 4, "c"), (2, None, "z"), (2, 1, "y")]
    df = spark.createDataFrame(data, "k int, t int, v string").repartition(5)
    assert rows(dedupe.first_per_key(df, ["k"], ["t"])) == [(1, 3, "a"), (2, None, "z")]
    assert rows(dedupe.latest_per_key(df, ["k"], ["t"])) == [(1, 4, "c"), (2, 1, "y")]


def test_upsert_takes_the_newest_update(spark):
    base = spark.createDataFrame([(1, "old", 9), (2, "keep", 0)], "k int, v string, ver int")
    updates = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "new", 1)], "k int, v string, ver int")
    assert rows(dedupe.upsert(base, updates, ["k"], "ver")) == [(1, "b", 2), (2, "keep", 0), (3, "new", 1)]


def test_sparse_update(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, nome string, cognome string")
    change = spark.createDataFrame([(1, None, "z")], "id int, nome string, cognome string")
    done = dedupe.sparse_update(base, change, "id", ["nome", "cognome"])
    assert [(r.id, r.nome, r.cognome, r.updated_at is not None) for r in done.orderBy("id").collect()] == [(1, "a", "z", True), (2, "b", "y", False)]


def test_as_of_join(spark):
    m = spark.createDataFrame([(1, "2024-01-05", 70), (1, "2024-01-10", None), (1, "2024-01-10", 71), (2, "2024-01-01", 60)], "athlete_id int, d string, kg int")
    s = spark.createDataFrame([(1, "2024-01-04 10:00:00", 1), (1, "2024-01-05 23:00:00", 2), (1, "2024-02-01 00:00:00", 3), (1, "2024-02-01 09:00:00", 4), (3, "2024-01-01 00:00:00", 5)],
                              "athlete_id int, at string, n int")
    found = joins.join_as_of(s.withColumn("at", F.to_timestamp("at")), m.withColumn("d", F.to_date("d")), "at", "d")
    assert rows(found, "n", "kg") == [(1, None), (2, 70), (3, 71), (4, 71), (5, None)]


def test_accept_for_active(spark):
    s = spark.createDataFrame([(1, "active"), (2, "ended")], "session_id int, status string")
    ok, rejected = joins.accept_for_active(spark.createDataFrame([(1,), (2,), (3,)], "session_id int"), s)
    assert rows(ok) == [(1,)]
    assert rows(rejected) == [(2, "session_not_active"), (3, "session_not_found")]


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "x double, inserts bigint, avg_intensity double, total_target_load bigint")
    assert tuple(rollups.period_summary(none, "x").first()) == (0.0, 0, 1.0, 0.0)
    assert tuple(rollups.weighted_summary(none).first()) == (0, 0.0, 0, 0)
    log = spark.createDataFrame([(1, False, 5.0)], "request_id int, success boolean, latency_ms double")
    got = rollups.latency_report(log, 0.0).first()
    assert (got.executed, got.succeeded, got.failed, got.latency_p95, got.latency_avg, got.requests_per_s) == (1, 0, 1, 0.0, 0.0, 0.0)


def test_share_of_peak_zero_and_floor(spark):
    df = spark.createDataFrame([(0,), (1,), (200,)], "x int")
    assert [r.share_pct for r in rollups.share_of_peak(df, "x", 6).orderBy("x").collect()] == [6, 6, 100]
    zero = spark.createDataFrame([(0,)], "x int")
    assert rollups.share_of_peak(zero, "x", 6).first().share_pct == 6 and rollups.share_of_peak(zero, "x").first().share_pct is None


def test_training_index_zero_divisors_and_day_limits(spark):
    data = [(1, 0, 10.0, "2024-02-01"), (2, 600, 0.0, "2024-02-01"), (3, 600, 10.0, "2024-01-14"), (4, 600, 10.0, "2024-01-13"), (5, 180, 10.0, "2024-02-01")]
    df = spark.createDataFrame(data, "atleta_id int, secondo int, speed_kmh double, d string").select(
        "*", F.to_timestamp("d").alias("ts"), F.lit(150.0).alias("heart_rate_bpm"), F.lit(20.0).alias("temperature_c"))
    days = {r.atleta: r for r in training_status.with_index(training_status.athlete_days(df)).collect()}
    assert days["1"].indice_allenamento is None and days["2"].indice_allenamento is None
    # 42 days old counts, 43 does not; a distance of exactly 500 m does not
    assert rows(training_status.mean_index(df, F.lit("2024-02-25").cast("date")), "atleta") == [("3",)]


def test_load_ratio(spark):
    df = spark.createDataFrame([(1, f"2024-01-{d:02d} 08:00:00", 10.0) for d in range(1, 29)] + [(1, "2024-01-28 18:00:00", 90.0)], "athlete_id int, at string, load double")
    last = load.load_ratio(df.withColumn("at", F.to_timestamp("at")), "at", "load").orderBy(F.col("day").desc()).first()
    assert (last.load, last.acute, last.chronic, last.flag) == (100.0, 160.0, 92.5, "danger")


def test_training_volumes_is_always_monday(spark):
    weekly = spark.createDataFrame([(i, "2025-01", 10.5) for i in range(9)] + [(1, "2024-52", 99.0)], "athlete_id int, week_id string, total_trimp double")
    found = dashboard.training_volumes(weekly).collect()
    assert [(r.athlete_id, r.day, r.load) for r in found] == [(i, "Lun", 11) for i in range(7)]


def test_single_plans(spark):
    df = spark.createDataFrame([("AT-012", "corsa", "45", "x", None), ("x", "corsa", None, "7", "n")], "athlete string, session_type string, duration_min string, intensity string, notes string")
    assert rows(dashboard.single_plans(df), "athlete_id", "duration_min", "intensity") == [(12, 45, None), (None, None, 7)]


def test_compact_json(spark):
    df = spark.createDataFrame([(1, "à")], "a int, b string")
    assert df.select(compact_json(F.struct("a", "b"))).first()[0] == '{"a":1,"b":"à"}'
    assert df.select(compact_json(F.lit(None).cast("struct<a:int>"))).first()[0] == "{}"
