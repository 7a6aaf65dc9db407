"""Streams over files written one after the other, against batch and hand-made results."""

import json
import os
import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from paceframe.config import DetectorConfig
from paceframe.operators.sessions import session_summary
from paceframe.operators.stillness import stillness_alerts
from paceframe.schemas import METRICS_EVENT, WORKOUT_EVENT
from paceframe.streaming import jobs, monitor, sinks
from paceframe.streaming.ingest import decode, heart_rate_events, without_redelivery
from paceframe.streaming.metrics import session_metrics, windowed_metrics

STEP = 11.0 / 111_194.9
ALERT = "athlete_id string, session_id bigint, sample_index bigint, still_for bigint, latitude double, longitude double, heart_rate_bpm double, message string"
SUMMARY = (
    "athlete_id string, session_id bigint, velocita_media double, velocita_max double, frequenza_cardiaca_media double, "
    "frequenza_cardiaca_max double, cadenza_media double, distanza_totale double, campioni bigint, durata_s double, end_reason string"
)


class Topic:
    """A folder of text files standing in for a topic; each file becomes one micro-batch."""

    def __init__(self, path):
        self.path = path
        os.makedirs(path)
        self.n = 0

    def send(self, *events):
        self.n += 1
        lines = [e if isinstance(e, str) else json.dumps(e) for e in events]
        file = self.path / f"{self.n:04d}.txt"
        file.write_text("\n".join(lines) + "\n")
        os.utime(file, (1_700_000_000 + self.n, 1_700_000_000 + self.n))

    def records(self, spark):
        return spark.readStream.option("maxFilesPerTrigger", 1).text(str(self.path))


@pytest.fixture
def topic(tmp_path):
    return Topic(tmp_path / "topic")


def at(seconds):
    return time.strftime("2024-01-01T%H:%M:%SZ", time.gmtime(seconds))


def sample(i, bpm=181.0, lat=42.9, athlete="1", session=1, seconds=None, **more):
    return {"athlete_id": athlete, "session_id": session, "heart_rate_bpm": bpm, "cadence_spm": 170, "latitude": lat, "longitude": 12.7,
            "sample_index": i, "timestamp": at(i if seconds is None else seconds), **more}


def end(i, athlete="1", session=1, seconds=None, kind="session_end"):
    return {"athlete_id": athlete, "session_id": session, "event_type": kind, "sample_index": i, "timestamp": at(i if seconds is None else seconds)}


def detect(spark, topic, tmp_path, name="d", **cfg):
    alerts, summaries = str(tmp_path / name / "alerts"), str(tmp_path / name / "summaries")
    query = jobs.detector_job(topic.records(spark), alerts, summaries, DetectorConfig(**cfg), str(tmp_path / name / "checkpoint"))
    query.awaitTermination()
    return sinks.read_sink(spark, alerts, ALERT), sinks.read_sink(spark, summaries, SUMMARY)


def test_alarm_state_survives_batches_and_ends_with_the_marker(spark, topic, tmp_path):
    topic.send(*[sample(i) for i in range(20)])
    topic.send(*[sample(i) for i in range(20, 40)], '{"broken', "")
    topic.send(end(40), *[sample(i, seconds=41 + i) for i in range(31)], end(31, seconds=72, kind="end"))
    alerts, summaries = detect(spark, topic, tmp_path)
    assert rows(alerts, "sample_index", "still_for") == [(30, 30), (30, 30)]
    assert rows(summaries, "campioni", "frequenza_cardiaca_media", "distanza_totale", "durata_s", "end_reason") == [
        (31, 181.0, 0.0, 155.0, "session_end"), (40, 181.0, 0.0, 200.0, "session_end")]


def test_order_inside_a_batch_does_not_matter(spark, topic, tmp_path):
    events = [sample(i, lat=42.9 + (i // 35) * STEP) for i in range(80)]
    topic.send(*events[::-1])
    alerts, _ = detect(spark, topic, tmp_path)
    assert rows(alerts, "sample_index") == [(30,), (65,)]


def test_second_dialect_alarms(spark, topic, tmp_path):
    topic.send(*[
        {"athlete_id": 9, "session_id": 1, "heart_rate": 185, "cadence": 1, "altitude": 2, "latitude": 42.9, "longitude": 12.7,
         "sample_id": i, "timestamp": at(i), "event_type": "sample"} for i in range(31)])
    alerts, _ = detect(spark, topic, tmp_path)
    assert rows(alerts, "athlete_id", "sample_index") == [("9", 30)]


def test_late_samples_count_repeated_ones_do_not_and_neither_moves_the_anchor(spark, topic, tmp_path):
    topic.send(*[sample(i, bpm=150.0) for i in range(0, 20, 2)])
    topic.send(sample(3, bpm=190.0, lat=43.0), sample(18, bpm=150.0, lat=43.0))
    topic.send(sample(20, bpm=150.0), end(21))
    alerts, summaries = detect(spark, topic, tmp_path)
    assert rows(alerts) == []
    assert rows(summaries, "campioni", "frequenza_cardiaca_max", "distanza_totale") == [(12, 190.0, 0.0)]


def test_redelivered_samples_count_once(spark, topic, tmp_path):
    topic.send(*[sample(i, bpm=100.0 + i) for i in range(4)])
    topic.send(*[sample(3, bpm=103.0)] * 2)
    topic.send(sample(3, bpm=103.0), end(4))
    _, summaries = detect(spark, topic, tmp_path)
    assert rows(summaries, "campioni", "frequenza_cardiaca_media") == [(4, 101.5)]


def test_idle_session_times_out(spark, topic, tmp_path):
    topic.send(*[sample(i) for i in range(5)])
    topic.send(sample(0, athlete="2", seconds=3 * 3600))
    topic.send(sample(1, athlete="2", seconds=3 * 3600 + 1))
    _, summaries = detect(spark, topic, tmp_path)
    assert rows(summaries, "athlete_id", "campioni", "end_reason") == [("1", 5, "timeout")]


def test_timer_moves_with_new_samples(spark, topic, tmp_path):
    topic.send(sample(0, seconds=0))
    topic.send(sample(1, seconds=3000))
    topic.send(sample(0, athlete="2", seconds=4300))
    topic.send(sample(1, athlete="2", seconds=4301))
    _, early = detect(spark, topic, tmp_path, idle_timeout="1 hour")
    assert rows(early) == []
    topic.send(sample(2, athlete="2", seconds=9000))
    topic.send(sample(3, athlete="2", seconds=9001))
    _, late = detect(spark, topic, tmp_path, idle_timeout="1 hour")
    assert rows(late, "athlete_id", "campioni") == [("1", 2)]


def test_restart_continues_from_the_checkpoint(spark, topic, tmp_path):
    events = [sample(i, lat=42.9 + (i // 40) * STEP, athlete=a, bpm=181.0 + i % 3) for i in range(100) for a in ("1", "2", "3")]
    topic.send(*events[:140])
    detect(spark, topic, tmp_path)
    topic.send(*events[140:], *[end(100, athlete=a) for a in ("1", "2", "3")])
    alerts, summaries = detect(spark, topic, tmp_path)
    whole = Topic(tmp_path / "whole")
    whole.send(*events, *[end(100, athlete=a) for a in ("1", "2", "3")])
    again, again_s = detect(spark, whole, tmp_path, "whole-d")
    assert rows(alerts) == rows(again) and alerts.count() == 6
    assert rows(summaries.drop("velocita_media", "distanza_totale")) == rows(again_s.drop("velocita_media", "distanza_totale"))


def test_stream_equals_batch(spark, topic, tmp_path):
    events = [sample(i, lat=42.9 + (i // (30 + int(a) * 3)) * STEP, athlete=a, bpm=170.0 + (i * int(a)) % 20) for a in ("1", "2", "3") for i in range(150)]
    for start in range(0, len(events), 100):
        topic.send(*sorted(events, key=lambda e: e["sample_index"])[start:start + 100])
    topic.send(*[end(150, athlete=a) for a in ("1", "2", "3")])
    alerts, summaries = detect(spark, topic, tmp_path)
    batch, _ = heart_rate_events(spark.read.text(str(topic.path)))
    batch = batch.withColumn("timestamp", F.col("event_time"))
    assert rows(alerts, "athlete_id", "sample_index", "message") == rows(stillness_alerts(batch), "athlete_id", "sample_index", "message")
    columns = ["athlete_id", *[F.round(c, 6).alias(c) for c in ("velocita_media", "velocita_max", "frequenza_cardiaca_media", "distanza_totale")], "campioni"]
    assert rows(summaries.select(*columns)) == rows(session_summary(batch).select(*columns))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_within_the_lateness_bound_equals_batch(spark, topic, tmp_path, seed):
    rng = random.Random(seed)
    events = [sample(i, lat=42.9 + (i // (30 + int(a) * 3)) * STEP, athlete=a, bpm=170.0 + (i * int(a)) % 20) for a in ("1", "2", "3") for i in range(150)]
    events += [end(150, athlete=a) for a in ("1", "2")]  # the third closes by its idle time
    sent = sorted([*events, *rng.sample(events, 60)], key=lambda e: e["sample_index"] + rng.uniform(0, 100))
    for start in range(0, len(sent), 90):
        topic.send(*sent[start : start + 90])
    batch, _ = heart_rate_events(spark.read.text(str(topic.path)))
    batch = batch.withColumn("timestamp", F.col("event_time"))
    columns = ["athlete_id", *[F.round(c, 6).alias(c) for c in ("velocita_media", "velocita_max", "frequenza_cardiaca_media", "distanza_totale")], "campioni"]
    whole = rows(session_summary(batch).select(*columns))
    alarms = rows(stillness_alerts(batch), "athlete_id", "sample_index", "message")
    topic.send(sample(0, athlete="9", seconds=50_000))
    alerts, summaries = str(tmp_path / "a"), str(tmp_path / "s")
    jobs.detector_job(topic.records(spark), alerts, summaries, DetectorConfig(buckets=2), str(tmp_path / "c"), late_by="2 minutes", in_order=True).awaitTermination()
    assert rows(sinks.read_sink(spark, summaries, SUMMARY).select(*columns)) == whole
    assert rows(sinks.read_sink(spark, summaries, SUMMARY), "athlete_id", "end_reason") == [("1", "session_end"), ("2", "session_end"), ("3", "timeout")]
    assert rows(sinks.read_sink(spark, alerts, ALERT), "athlete_id", "sample_index", "message") == alarms


def test_gaps_close_sessions_in_order_whatever_the_batches(spark, topic, tmp_path):
    first, second = [sample(i, seconds=i) for i in range(5)], [sample(i, seconds=9000 + i) for i in range(5, 8)]
    topic.send(*second, *first)
    topic.send(sample(0, athlete="9", seconds=40_000))
    _, together = detect_in_order(spark, topic, tmp_path, "one")
    assert rows(together, "campioni", "end_reason") == [(3, "timeout"), (5, "timeout")]


def detect_in_order(spark, topic, tmp_path, name):
    alerts, summaries = str(tmp_path / name / "a"), str(tmp_path / name / "s")
    jobs.detector_job(topic.records(spark), alerts, summaries, DetectorConfig(), str(tmp_path / name / "c"), late_by="3 hours", in_order=True).awaitTermination()
    return sinks.read_sink(spark, alerts, ALERT), sinks.read_sink(spark, summaries, SUMMARY)


def metric(i, seconds, athlete=1):
    return {"athlete_id": athlete, "workout_id": i, "timestamp": at(seconds), "power": 100 + i, "heart_rate": 140, "speed": 10, "distance": i}


def test_windows_close_once_and_late_rows_are_counted(spark, topic, tmp_path):
    topic.send(metric(1, 0), metric(2, 200), metric(3, 400))
    topic.send(metric(4, 4000))
    topic.send(metric(7, 4050))  # late rows are judged by the watermark of the batch before
    topic.send(metric(5, 100), metric(6, 4100))
    query = jobs.metrics_job(topic.records(spark), str(tmp_path / "m"), str(tmp_path / "c"))
    query.awaitTermination()
    schema = "athlete_id int, window_start timestamp, avg_power double, max_power float, total_distance float"
    found = sinks.read_sink(spark, str(tmp_path / "m"), schema)
    assert rows(found, F.date_format("window_start", "HH:mm").alias("w"), "avg_power", "total_distance") == [
        ("00:00", 101.5, 2.0), ("00:05", 103.0, 3.0)]
    progress = monitor.progress_table(query)
    assert progress.agg(F.sum("dropped_by_watermark"), F.sum("input_rows")).first()[:] == (1, 7)


def test_windowed_metrics_stream_equals_batch(spark, topic, tmp_path):
    topic.send(*[metric(i, i * 37, 1 + i % 3) for i in range(200)])
    topic.send(metric(1000, 80_000, 1))
    events = decode(topic.records(spark), METRICS_EVENT)
    for n, build in enumerate((windowed_metrics, lambda e: windowed_metrics(e, "10 minutes", "5 minutes"), session_metrics)):
        path = str(tmp_path / f"w{n}")
        live = build(events)
        sinks.run_available(live, sinks.parquet_sink(path), "w")
        whole = build(decode(spark.read.text(str(topic.path)), METRICS_EVENT)).filter("window_end < '2024-01-01 20:00:00'")
        assert rows(sinks.read_sink(spark, path, live.schema)) == rows(whole)


def test_redelivered_samples_are_dropped(spark, topic, tmp_path):
    topic.send(sample(1), sample(1), sample(2))
    topic.send(sample(2), sample(3))
    events, _ = heart_rate_events(topic.records(spark))
    sinks.run_available(without_redelivery(events).select("sample_index"), sinks.parquet_sink(str(tmp_path / "o")), "x")
    assert rows(sinks.read_sink(spark, str(tmp_path / "o"), "sample_index bigint")) == [(1,), (2,), (3,)]


def test_empty_batches_write_nothing_and_replays_overwrite(spark, tmp_path):
    path = str(tmp_path / "p")
    write = sinks.parquet_sink(path)
    write(spark.range(0), 0)
    assert not os.path.exists(path) and sinks.read_sink(spark, path, "id bigint").count() == 0
    write(spark.range(3), 1)
    write(spark.range(3), 1)
    assert sinks.read_sink(spark, path, "id bigint").count() == 3


def test_upsert_sink_keeps_newest_over_batches_and_replays(spark, tmp_path):
    path, schema = str(tmp_path / "u"), "k int, ver int, v string"
    kind = spark.createDataFrame([], schema).schema
    write = sinks.upsert_sink(path, ["k"], "ver")
    assert sinks.read_upserted(spark, path, kind, ["k"], ["ver"]).count() == 0
    write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 0, "x")], schema), 0)
    for _ in range(2):
        write(spark.createDataFrame([(1, 2, "c"), (3, 1, "d"), (2, 1, "same version, later batch")], schema), 1)
    expected = [(1, 2, "c"), (2, 1, "same version, later batch"), (3, 1, "d")]
    assert rows(sinks.read_upserted(spark, path, kind, ["k"], ["ver"])) == expected
    sinks.compact(spark, path, str(tmp_path / "v"), kind, ["k"], ["ver"])
    sinks.upsert_sink(str(tmp_path / "v"), ["k"], "ver")(spark.createDataFrame([(3, 2, "e")], schema), 2)
    assert rows(sinks.read_upserted(spark, str(tmp_path / "v"), kind, ["k"], ["ver"]))[2] == (3, 2, "e")


def test_workout_events_and_monitoring(spark, topic, tmp_path):
    topic.send({"athlete_id": 1, "workout_id": 2, "date": "2024-01-01", "duration_minutes": 30, "status": "completed"}, "nope")
    query = jobs.workouts_job(topic.records(spark), sinks.json_sink(str(tmp_path / "w")), str(tmp_path / "c"))
    query.awaitTermination()
    back = spark.read.schema(WORKOUT_EVENT).option("recursiveFileLookup", "true").json(str(tmp_path / "w"))
    assert rows(back) == [(1, 2, "2024-01-01", 30, "completed")]
    live = sinks.start(topic.records(spark), sinks.json_sink(str(tmp_path / "x")), "live", str(tmp_path / "c2"), interval="1 hour")
    assert rows(monitor.active_queries(spark), "id") == [(str(live.id),)]
    monitor.stop_all(spark)
    assert monitor.active_queries(spark).count() == 0


def test_dead_letters_and_archive(spark, topic, tmp_path):
    topic.send(sample(1), "x", sample(2, bpm=None), end(3), sample(1))
    jobs.dead_letter_job(topic.records(spark), str(tmp_path / "dead")).awaitTermination()
    jobs.archive_job(topic.records(spark), str(tmp_path / "archive")).awaitTermination()
    dead = sinks.read_sink(spark, str(tmp_path / "dead"), "raw string, reasons array<string>")
    assert [r[0][0] for r in rows(dead, "reasons")] == ["heart_rate_missing", "malformed"]
    kept = sinks.read_sink(spark, str(tmp_path / "archive"), "sample_index bigint, event_type string")
    assert rows(kept) == [(1, "sample"), (3, "session_end")]


def test_archive_batch_replayed_after_a_crash_adds_nothing_and_months_are_pruned(spark, topic, tmp_path):
    path, checkpoint = str(tmp_path / "archive"), str(tmp_path / "c")
    assert sinks.read_files(spark, path, jobs.ARCHIVE).count() == 0
    topic.send(*[sample(i) for i in range(5)], {**sample(9), "timestamp": "2024-02-03T00:00:00Z"})
    jobs.archive_job(topic.records(spark), path, checkpoint, late_by="60 days").awaitTermination()
    sinks.forget_commits(spark, checkpoint)
    topic.send(*[sample(i) for i in range(3, 8)])
    jobs.archive_job(topic.records(spark), path, checkpoint, late_by="60 days").awaitTermination()
    stray = tmp_path / "archive" / "ym=202401" / "part-of-a-lost-task.parquet"
    stray.hardlink_to(next((tmp_path / "archive" / "ym=202401").glob("part-*.parquet")))
    back = sinks.read_files(spark, path, jobs.ARCHIVE)
    assert rows(back, "ym", "sample_index") == [(202401, i) for i in range(8)] + [(202402, 9)]
    month = back.where("ym = 202402")
    assert rows(month, "sample_index") == [(9,)]
    plan = month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan


def test_state_partitions_come_from_the_checkpoint_and_settings_are_put_back(spark, topic, tmp_path):
    before = {k: spark.conf.get(k, None) for k in sinks.state_settings(spark)}
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def run(partitions):
        events, _ = heart_rate_events(topic.records(spark))
        live = without_redelivery(events, "1 hour").select("sample_index")
        sinks.start(live, sinks.parquet_sink(path), "p", checkpoint, state_partitions=partitions).awaitTermination()

    topic.send(sample(1), sample(2))
    run(3)
    assert {k: spark.conf.get(k, None) for k in before} == before
    topic.send(sample(2), sample(3))
    run(7)
    assert rows(sinks.read_sink(spark, path, "sample_index bigint")) == [(1,), (2,), (3,)]
    assert sorted(p for p in os.listdir(tmp_path / "c" / "state" / "0") if p.isdigit()) == ["0", "1", "2"]


def test_a_backlog_is_dealt_over_more_buckets_and_tasks(spark, tmp_path, monkeypatch):
    """What a worker of the detector holds does not grow with the table; the rows stay the same."""
    from paceframe.registry import adapters, load_all

    events = spark.range(600).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 60) AS ts", "id % 7 AS user_id", "'view' AS event_type",
        "id % 90 + 0.5D AS value", "'' AS props")
    events.select([c.split()[0] for c in adapters.TABLES["events"].split(", ")]).repartition(3).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    cores, found = spark.sparkContext.defaultParallelism, []
    started = sinks.start
    monkeypatch.setattr(sinks, "start", lambda *a: (found.append(a[5]), started(*a))[1])
    queries = load_all().queries
    for name in ("L8_session_summaries", "L8_detector_alerts"):
        small = rows(queries[name](spark, str(tmp_path / "sf")))
        assert found.pop() == cores
        with monkeypatch.context() as m:
            m.setattr(jobs, "TASK_EVENTS", 600 // (cores + 2))
            m.setattr(jobs, "BUCKET_EVENTS", 2)
            assert rows(queries[name](spark, str(tmp_path / "sf"))) == small
            assert found.pop() >= cores + 2
    assert jobs.for_backlog(spark, DetectorConfig(), 36_000_000)[0].buckets == 1440
