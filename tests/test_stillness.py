"""Detector traces, on the bounded operator."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from paceframe.config import DetectorConfig, HotGroups
from paceframe.operators import stillness
from paceframe.operators.stillness import hull, metres, metres_between, scan, scan_arrays, stillness_alerts

STEP = 11.0 / 111_194.9  # degrees of latitude for 11 m


def trace(spark, samples, athlete="1", session=1):
    data = [(athlete, session, i, lat, 12.7, bpm, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i, lat, bpm in samples]
    df = spark.createDataFrame(data, "athlete_id string, session_id bigint, sample_index bigint, latitude double, longitude double, heart_rate_bpm double, t string")
    return df.withColumn("timestamp", F.to_timestamp("t")).withColumn("event_type", F.lit("sample"))


def alarms(df):
    return [r[0] for r in rows(stillness_alerts(df), "sample_index")]


def test_moving_never_alarms(spark):
    assert alarms(trace(spark, [(i, 42.9 + i * STEP, 190.0) for i in range(60)])) == []


def test_one_alarm_per_anchor(spark):
    assert alarms(trace(spark, [(i, 42.9, 181.0) for i in range(60)])) == [30]


def test_limits_are_strict(spark):
    assert alarms(trace(spark, [(i, 42.9, 180.0) for i in range(60)])) == []
    assert alarms(trace(spark, [(i, 42.9, 181.0) for i in range(30)])) == []


def test_second_alarm_after_moving(spark):
    still = [(i, 42.9, 185.0) for i in range(31)] + [(i, 42.9 + STEP, 185.0) for i in range(31, 70)]
    assert alarms(trace(spark, still)) == [30, 61]


def test_gap_in_index_counts(spark):
    assert alarms(trace(spark, [(0, 42.9, 185.0), (30, 42.9, 185.0)])) == [30]


def test_redelivery_and_interleaved_sessions(spark):
    one = trace(spark, [(i, 42.9, 181.0) for i in range(40)])
    two = trace(spark, [(i, 42.9, 179.0 if i < 35 else 182.0) for i in range(40)], session=2)
    found = rows(stillness_alerts(one.unionByName(one).unionByName(two).repartition(3)), "session_id", "sample_index")
    assert found == [(1, 30), (2, 35)]


def test_message_and_missing_position(spark):
    df = trace(spark, [(0, 42.9, 181.0), (20, None, 199.0), (30, 42.9, 181.4)])
    assert [r.message for r in stillness_alerts(df).collect()] == ["Atleta 1 fermo da 30 s in posizione 42.900000, 12.700000 (bpm 181)"]


def test_scan_can_be_resumed():
    rows_ = [(i, 42.9 + (i // 37) * STEP, 12.7, 185.0) for i in range(200)]
    whole = scan(iter(rows_), None, DetectorConfig())
    state, first = scan(iter(rows_[:83]), None, DetectorConfig())
    state, rest = scan(iter(rows_[83:]), state, DetectorConfig())
    assert (state, first + rest) == whole


def test_metres():
    assert metres(42.9, 12.7, 42.9 + STEP, 12.7) == pytest.approx(11.0, rel=1e-4)


def walk(rng, n, moves=(0, 1e-6, 3e-5, 8e-5, 2e-4)):
    """Samples of rests, strolls and runs, some without a position or a heart rate."""
    lat, lon, index, pace, out = 42.9, 12.7, 0, 0, []
    for _ in range(n):
        if rng.random() < 0.02:
            pace = rng.choice(moves)
        lat, lon, index = lat + rng.gauss(0, 1) * pace, lon + rng.gauss(0, 1) * pace, index + rng.randint(1, 4)
        out.append((index, math.nan if rng.random() < 0.03 else lat, lon, rng.choice([170.0, 181.0, 190.0, math.nan])))
    return out


def slow_scan(samples, state, cfg):
    """The rule, sample by sample."""
    alerts = []
    for index, lat, lon, bpm in samples:
        if lat != lat or lon != lon:
            continue
        if state is None or metres(state[0], state[1], lat, lon) > cfg.move_m:
            state = (lat, lon, index, False)
        elif index - state[2] >= cfg.still_index and not state[3] and bpm > cfg.alarm_bpm:
            state = (*state[:3], True)
            alerts.append((index, index - state[2], lat, lon, bpm))
    return state, alerts


@pytest.mark.parametrize("seed", range(40))
def test_array_scan_equals_the_rule_sample_by_sample(seed):
    rng = random.Random(seed)
    samples = walk(rng, rng.randint(0, 700))
    cut = rng.randint(0, len(samples))
    columns = [np.array(c) for c in zip(*samples, strict=True)] or [np.zeros(0)] * 4
    columns[0] = columns[0].astype(np.int64)
    state, first = scan_arrays(*(c[:cut] for c in columns), None, DetectorConfig())
    state, rest = scan_arrays(*(c[cut:] for c in columns), state, DetectorConfig())
    assert (state, first + rest) == slow_scan(samples, None, DetectorConfig())


def test_hull_corners_are_the_farthest_positions():
    rng = np.random.default_rng(1)
    for spread in (1e-6, 5e-5, 1e-4):
        lat, lon = 60 + rng.normal(0, spread, 500).round(6), 12.7 + rng.normal(0, spread, 500).round(6)
        wide, lats, lons = hull(lat, lon, DetectorConfig(move_m=40.0))
        if wide or not lats:
            assert spread == 1e-4
            continue
        assert len(lats) < 60
        for a, b in rng.normal(0, 3 * spread, (30, 2)):
            assert metres_between(60 + a, 12.7 + b, np.array(lats), np.array(lons)).max() == pytest.approx(metres_between(60 + a, 12.7 + b, lat, lon).max(), abs=1e-4)
    assert hull(np.array([42.9, 42.9 + 3 * STEP]), np.array([12.7, 12.7]), DetectorConfig()) == (True, [], [])
    assert hull(np.array([89.0, 89.0]), np.array([1.0, 1.0]), DetectorConfig()) == (False, [], [])


@pytest.mark.parametrize(("kind", "most"), [("rest", 3), ("walk", 15)])
def test_a_hot_session_settles_in_few_rounds(spark, monkeypatch, kind, most):
    """1000 pieces: a rest with a jittering position passes in one sweep, a walk takes a few."""
    rng = random.Random(3)
    if kind == "rest":
        samples = [(i, 42.9 + rng.uniform(-4e-5, 4e-5), 12.7 + rng.uniform(-4e-5, 4e-5), 179.0 if i < 2000 else 185.0) for i in range(3000)]
    else:
        samples = walk(rng, 3000)
    df = spark.createDataFrame([("1", 1, i, *[None if x != x else x for x in rest]) for i, *rest in samples], "athlete_id string, session_id bigint, sample_index bigint, latitude double, longitude double, heart_rate_bpm double")
    df = df.withColumn("timestamp", F.timestamp_seconds("sample_index")).withColumn("event_type", F.lit("sample"))
    rounds = []
    plain = stillness.written
    monkeypatch.setattr(stillness, "written", lambda frame, name: rounds.append(name) or plain(frame, name))
    found = stillness_alerts(df, DetectorConfig(hot=HotGroups(max_rows=100, chunk_rows=3)))
    assert rows(found, "sample_index", "still_for") == sorted(((a[0], a[1]) for a in slow_scan(samples, None, DetectorConfig())[1]), key=repr)
    assert rounds.count("stillness-entries") <= most
