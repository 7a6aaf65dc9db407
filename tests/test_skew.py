"""A third or more of the rows in one group must change the plan, never the result."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from paceframe.config import DetectorConfig, DriftConfig, HotGroups
from paceframe.operators import sessions, skew, stillness, timeseries
from paceframe.operators.ranking import population_rank
from paceframe.operators.rollups import nearest_rank

TINY = HotGroups(max_rows=60, chunk_rows=70)


@pytest.fixture(scope="module")
def samples(spark):
    """One session with a third of the rows, many small ones, gaps, copies and NULLs."""
    rng = random.Random(7)
    data = []
    for athlete, session, n in [(1, 1, 400), *[(a, s, 20) for a in range(2, 22) for s in (1, 2)]]:
        index = 0
        lat, lon = 42.9, 12.7
        for _ in range(n):
            index += rng.choice([1, 1, 1, 5000, 9])
            if rng.random() < 0.6:
                lat, lon = lat + rng.uniform(-2e-4, 2e-4), lon + rng.uniform(-2e-4, 2e-4)
            bpm = None if rng.random() < 0.02 else rng.randint(150, 195)
            row = (index, athlete, session, f"2024-01-01 00:00:{index % 60:02d}", bpm, lat, lon, 170)
            data.extend([row] * (3 if rng.random() < 0.1 else 1))
    df = spark.createDataFrame(
        data, "sample_id bigint, athlete_id bigint, session_id bigint, t string, heart_rate int, latitude double, longitude double, cadence int"
    )
    return df.withColumn("timestamp", F.to_timestamp("t")).drop("t").repartition(6).cache()


@pytest.fixture(scope="module")
def events(samples):
    return samples.filter("heart_rate is not null").select(
        F.col("athlete_id").cast("string").alias("athlete_id"), "session_id", F.col("sample_id").alias("sample_index"),
        "timestamp", F.col("heart_rate").cast("double").alias("heart_rate_bpm"), F.col("cadence").cast("double").alias("cadence_spm"),
        "latitude", "longitude", F.lit("sample").alias("event_type"),
    )


def rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def test_running_count_and_position(spark):
    rng = random.Random(3)
    axis = sorted({rng.randrange(10**rng.randint(1, 12)) for _ in range(500)})
    df = spark.createDataFrame([(k, a) for k in (1, 2) for a in axis], "k int, a bigint")
    counts = {(r.k, r.a): r.before for r in skew.running_count(df, ["k"], "a").collect()}
    places = {(r.k, r.a): r._pos for r in skew.dense_position(df, ["k"], "a").collect()}
    for k in (1, 2):
        for i, a in enumerate(axis):
            assert counts[k, a] == i and places[k, a] == i


def test_negative_axis(spark):
    df = spark.createDataFrame([(1, a) for a in (-9000, -5, 0, 4, 10**7)], "k int, a bigint")
    assert [r._pos for r in skew.dense_position(df, ["k"], "a").orderBy("a").collect()] == [0, 1, 2, 3, 4]


def test_chunks_repeat_only_the_halo(spark):
    df = spark.range(10).withColumnRenamed("id", "_pos")
    cut = skew.chunk_with_halo(df, 4, 2)
    assert rows(cut.filter("not _halo"), "_pos", "_chunk") == [(i, i // 4) for i in range(10)]
    assert rows(cut.filter("_halo"), "_pos", "_chunk") == [(2, 1), (3, 1), (6, 2), (7, 2)]


def test_features_do_not_depend_on_the_cut(samples):
    plain = timeseries.session_features(samples, DriftConfig())
    cut = timeseries.session_features(samples, DriftConfig(hot=TINY))
    assert plain.count() > 1000
    assert rows(rounded(plain)) == rows(rounded(cut.select(*plain.columns)))


def test_crisis_points_do_not_depend_on_the_cut(samples):
    plain, cut = timeseries.crisis_points(samples), timeseries.crisis_points(samples, DriftConfig(hot=TINY))
    assert plain.count() > 10
    assert rows(rounded(plain)) == rows(rounded(cut))


def test_drift_paths_agree(samples):
    """The aggregate baseline and the windowed one lead to the same crisis points."""
    features = timeseries.session_features(samples)
    joined = features.join(timeseries.session_baseline(features), ["athlete_id", "session_id"], "left")
    drift = timeseries.with_drift(joined).filter("drift_pct > 5")
    first = drift.groupBy("athlete_id", "session_id").agg(F.min(F.struct("timestamp", "sample_id")).alias("f"))
    assert rows(first.select("athlete_id", "session_id", "f.sample_id")) == rows(
        timeseries.crisis_points(samples).select("athlete_id", "session_id", "sample_id")
    )


def test_summary_does_not_depend_on_the_cut(events):
    plain = sessions.session_summary(events)
    cut = sessions.session_summary(events, DetectorConfig(hot=TINY))
    assert rows(plain.select("*", F.lit(1)).transform(lambda d: rounded(d).withColumn("distanza_totale", F.round("distanza_totale", 5)))) == rows(
        cut.select("*", F.lit(1)).transform(lambda d: rounded(d).withColumn("distanza_totale", F.round("distanza_totale", 5)))
    )


@pytest.mark.parametrize("move_m", [10.0, 25.0, 1e9])
def test_stillness_does_not_depend_on_the_cut(events, move_m):
    plain = stillness.stillness_alerts(events, DetectorConfig(move_m=move_m))
    cut = stillness.stillness_alerts(events, DetectorConfig(move_m=move_m, hot=HotGroups(max_rows=60, chunk_rows=13)))
    found = rows(plain)
    assert found and found == rows(cut)


@pytest.mark.parametrize("missing", ["athlete_id", "session_id"])
def test_stillness_without_a_key_does_not_depend_on_the_cut(spark, missing):
    columns = "athlete_id string, session_id bigint, sample_index bigint, latitude double, longitude double, heart_rate_bpm double"
    data = [(None if missing == "athlete_id" else "1", None if missing == "session_id" else 1, i, 42.9 + (i // 45) * 0.001, 12.7, 185.0) for i in range(200)]
    df = spark.createDataFrame(data, columns).withColumn("timestamp", F.timestamp_seconds(F.col("sample_index"))).withColumn("event_type", F.lit("sample"))
    df = _with_nulls(df, [missing], "sample_index").cache()
    found = rows(stillness.stillness_alerts(df), "sample_index", missing)
    assert all(r[1] is None for r in found)
    cut = stillness.stillness_alerts(df, DetectorConfig(hot=HotGroups(max_rows=60, chunk_rows=13)))
    assert found == rows(cut, "sample_index", missing) and [r[0] for r in found] == [120, 165, 75]


def test_empty_input(spark, samples):
    none = samples.filter("athlete_id < 0")
    assert rows(timeseries.crisis_points(none)) == []


def test_position_in_batch(samples):
    unique = timeseries.unique_samples(samples)
    placed = sessions.batch_position(unique.withColumn("base", F.lit(10)), ["athlete_id", "session_id"], "sample_id", "base")
    per = placed.groupBy("athlete_id", "session_id").agg(F.min("sample_index"), F.max("sample_index"), F.count("*"))
    assert all(lo == 10 and hi == 10 + n - 1 for _, _, lo, hi, n in rows(per))


def test_nearest_rank(spark):
    for n, expected in [(1, 1.0), (20, 19.0), (100, 95.0)]:
        df = spark.range(1, n + 1).select(F.col("id").cast("double").alias("v"))
        assert nearest_rank(df, "v", 0.95).first().value == expected
    assert nearest_rank(df.filter("v < 0"), "v", 0.95).first().value is None


def test_population_rank_with_ties_and_one_row(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0), (4, 9.0), (5, None)], "id int, v double")
    found = {r.id: (r.percent_rank, r.percentile) for r in population_rank(df, "v").collect()}
    assert found[1] == (0.0, 1) and found[2] == found[3] == (pytest.approx(1 / 3), 34) and found[4] == (1.0, 100)
    assert found[5] == (None, None)
    alone = population_rank(df.filter("id = 1"), "v").first()
    assert (alone.percent_rank, alone.percentile, alone.z_score) == (0.0, 1, None)


@pytest.mark.parametrize("n_prev", [4, 60])
def test_running_totals_give_the_frame_mean(spark, n_prev):
    from pyspark.sql import Window

    rng = random.Random(n_prev)
    df = spark.createDataFrame([(i % 3, i, None if rng.random() < 0.3 or i < 20 else rng.randint(40, 220)) for i in range(300)], "k int, i int, v int")
    w = Window.partitionBy("k").orderBy("i")
    both = timeseries.trailing_mean(df, "v", "fast", w, n_prev)
    both = both.withColumn("slow", F.avg("v").over(w.rowsBetween(-n_prev, 0)))
    assert both.filter(~F.col("fast").eqNullSafe(F.col("slow"))).count() == 0


def _with_nulls(df, keys, axis):
    """The rows, and some whose axis or key is missing."""
    one = df.limit(3)
    return df.unionByName(one.withColumn(axis, F.lit(None).cast(df.schema[axis].dataType))).unionByName(
        df.limit(7).withColumn(keys[0], F.lit(None).cast(df.schema[keys[0]].dataType))
    )


def test_position_keeps_rows_without_axis_or_key(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), (None, 1), (None, 3), ("b", 9)], "k string, a long")
    assert rows(skew.dense_position(df, ["k"], "a")) == rows(
        spark.createDataFrame([("a", None, 0), ("a", 5, 1), (None, 1, 0), (None, 3, 1), ("b", 9, 0)], "k string, a long, p long")
    )


def test_missing_axis_and_keys_do_not_depend_on_the_cut(spark, samples, events):
    keyed = _with_nulls(events, ["athlete_id", "session_id"], "sample_index").cache()
    small, large = DetectorConfig(hot=HotGroups(max_rows=5, chunk_rows=4)), DetectorConfig(hot=HotGroups(max_rows=10**9))
    one, two = (rows(sessions.session_summary(keyed, c).select("athlete_id", "session_id", "campioni")) for c in (small, large))
    assert one == two and any(r[0] is None for r in one)
    keyed = _with_nulls(samples, ["athlete_id", "session_id"], "sample_id").cache()
    small, large = DriftConfig(hot=HotGroups(max_rows=5, chunk_rows=4)), DriftConfig(hot=HotGroups(max_rows=10**9))
    assert timeseries.session_features(keyed, small).count() == timeseries.session_features(keyed, large).count()


def test_ranks_use_the_values_themselves(spark):
    df = spark.createDataFrame([(i, 1.0 + i * 1e-9) for i in range(5)] + [(9, None)], "id int, v double")
    assert sorted(r.percent_rank for r in population_rank(df, "v").collect() if r.v is not None) == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert nearest_rank(df, "v", 0.5).first().value == 1.0 + 2e-9
