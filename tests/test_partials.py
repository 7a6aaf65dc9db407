"""Incremental roll-ups against a full recompute, and what a refresh touches."""

import os
import random

from conftest import rows
from pyspark.sql import functions as F

from paceframe.plans.partials import DailyPartials

MEASURES = {"total": ("sum", "load"), "n": ("count", "load"), "least": ("min", "load"), "most": ("max", "load")}


def facts_of(spark, data):
    return spark.createDataFrame(data, "athlete_id long, at string, load double").withColumn("at", F.to_timestamp("at")).repartition(3)


def data_of(seed):
    rng = random.Random(seed)
    days = [f"2024-{m:02d}-{d:02d} 1{d % 10}:00:00" for m in (1, 2, 3, 4) for d in (1, 9, 17, 28)]
    return [(rng.randint(1, 5), rng.choice([*days, None]), rng.choice([None, 1.0, 2.5, 4.0])) for _ in range(400)]


def files(path):
    return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_late_correction_rewrites_its_month_alone(spark, tmp_path):
    data = data_of(1)
    partials = DailyPartials(str(tmp_path / "p"), ["athlete_id"], "at", MEASURES)
    partials.build(facts_of(spark, data))
    before = files(tmp_path / "p")
    late = [r for r in data if not (r[1] or "").startswith("2024-02-09")] + [(2, "2024-02-09 08:00:00", 100.0), (7, "2024-02-09 23:59:59", 3.0)]
    partials.refresh(facts_of(spark, late), spark.createDataFrame([("2024-02-09",)], "day string"))
    after = files(tmp_path / "p")
    changed = {d for d, f in before.items() ^ after.items() for d in [d[0]]}
    assert {os.path.basename(d) for d in changed} == {"ym=202402"}
    assert rows(partials.read(spark).select("athlete_id", "day", *MEASURES)) == rows(partials.of(facts_of(spark, late)).select("athlete_id", "day", *MEASURES))
    expected = facts_of(spark, late).groupBy("athlete_id").agg(F.sum("load"), F.count("load"), F.min("load"), F.max("load"))
    assert rows(partials.merged(spark, "athlete_id")) == rows(expected)


def test_days_and_months_that_lose_their_rows_and_days_without_a_date(spark, tmp_path):
    data = data_of(2)
    partials = DailyPartials(str(tmp_path / "p"), ["athlete_id"], "at", MEASURES)
    partials.build(facts_of(spark, data))
    late = [r for r in data if r[1] is not None and not r[1].startswith("2024-03")] + [(1, None, 9.0), (3, "2025-01-01 00:00:00", 1.0)]
    days = [(f"2024-03-{d:02d}",) for d in (1, 9, 17, 28)] + [(None,), ("2025-01-01",), ("2030-01-01",)]
    partials.refresh(facts_of(spark, late), spark.createDataFrame(days, "day string"))
    assert rows(partials.read(spark).select("athlete_id", "day", *MEASURES)) == rows(partials.of(facts_of(spark, late)).select("athlete_id", "day", *MEASURES))


def test_a_refresh_without_days_changes_nothing(spark, tmp_path):
    partials = DailyPartials(str(tmp_path / "p"), ["athlete_id"], "at", MEASURES)
    partials.build(facts_of(spark, data_of(3)))
    before = files(tmp_path / "p")
    partials.refresh(facts_of(spark, []), spark.createDataFrame([], "day string"))
    assert files(tmp_path / "p") == before
