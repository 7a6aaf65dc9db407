import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from paceframe.plans import workout_elt as W
from paceframe.runtime import written

BENCH = {"nome": "Panca piana", "serie": 4, "ripetizioni": 8, "recupero_secondi": 90, "carico_kg": 62.5}
PLANK = {"nome": "Plank", "serie": 3, "recupero_secondi": 40, "durata_secondi": 60}


def source(spark, *documents, first_id=1):
    data = [(first_id + i, 7, "2024-05-06", d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    df = spark.createDataFrame(data, "id bigint, athlete_id bigint, d string, struttura_allenamento string")
    return df.select("id", "athlete_id", F.to_date("d").alias("data_allenamento"), "struttura_allenamento",
                     F.lit("2024-05-06 10:00:00").cast("timestamp").alias("created_at"))


def sets(spark, *documents):
    good, bad = W.workout_sets(W.to_raw(source(spark, *documents)))
    cols = ["nome_esercizio", "serie_allenamento", "ripetizioni_allenamento", "recupero_allenamento", "peso_allenamento"]
    return [(*r[:4], float(r[4])) for r in rows(good, *cols)], [(r.nome, r.serie, r.reasons) for r in bad.collect()]


def test_one_row_per_set(spark):
    good, bad = sets(spark, {"tipo": "palestra", "esercizi": [BENCH, PLANK]})
    assert good == [("Panca piana", i, 8, 90, 62.5) for i in (1, 2, 3, 4)] + [("Plank", i, 0, 40, 0.0) for i in (1, 2, 3)]
    assert bad == []


@pytest.mark.parametrize("document", [
    None, {}, {"esercizi": []}, {"esercizi": None}, {"esercizi": [{**BENCH, "serie": 0}]},
    {"esercizi": [{"nome": "x"}]}, {"allenamento": {"esercizi": [{"nome": "x", "serie": []}]}}, {"allenamento": {}},
])
def test_no_rows(spark, document):
    assert sets(spark, document) == ([], [])


@pytest.mark.parametrize("document", ["not json", "", '{"esercizi":[', {"esercizi": [{**BENCH, "serie": "4"}]}, '{"esercizi":[{"nome":"x","serie":3.0}]}'])
def test_unreadable_documents_are_quarantined(spark, document):
    good, bad = sets(spark, document, {"esercizi": [PLANK]})
    assert len(good) == 3
    assert bad == [(None, None, ["document_unreadable"])]


def test_a_load_quarantines_unreadable_documents_once(spark, tmp_path):
    paths = W.LoadPaths(*[str(tmp_path / n) for n in ("staging", "target", "quarantine")])
    todo = source(spark, {"esercizi": [BENCH]}, "not json", {"esercizi": [PLANK]})
    W.run_load(todo, paths)
    W.to_raw(todo).write.mode("append").parquet(paths.staging)
    W.run_load(todo, paths)
    assert rows(spark.read.parquet(paths.quarantine), "allenamento_id", "reasons") == [(2, ["document_unreadable"])]


def test_listed_sets(spark):
    listed = {"nome": "Military Press", "serie": [{"numero": 1, "ripetizioni": 10, "carico_kg": 30}, {"ripetizioni": 8}]}
    good, _ = sets(spark, {"allenamento": {"esercizi": [listed]}})
    assert good == [("Military Press", 1, 10, 0, 30.0), ("Military Press", 2, 8, 0, 0.0)]


def test_both_shapes_in_one_document(spark):
    good, _ = sets(spark, {"esercizi": [PLANK], "allenamento": {"esercizi": [{"nome": "A", "serie": [{"ripetizioni": 5}]}]}})
    assert [g[0] for g in good] == ["A", "Plank", "Plank", "Plank"]


def test_out_of_range_is_quarantined_whole(spark):
    good, bad = sets(spark, {"esercizi": [
        {**BENCH, "recupero_secondi": 300, "serie": 1}, {**BENCH, "carico_kg": 1000, "serie": 1}, {**BENCH, "serie": 10**9}, {**BENCH, "ripetizioni": -1, "serie": 1},
    ]})
    assert good == []
    assert sorted(bad) == sorted([
        ("Panca piana", 1, ["recupero_range"]), ("Panca piana", 1, ["carico_range"]),
        ("Panca piana", 10**9, ["serie_range"]), ("Panca piana", 1, ["ripetizioni_range"]),
    ])


def test_load_is_incremental_and_repeatable(spark, tmp_path):
    paths = W.LoadPaths(*[str(tmp_path / n) for n in ("staging", "target", "quarantine")])
    first = source(spark, {"esercizi": [BENCH]}, {"esercizi": [PLANK, {**BENCH, "serie": 1, "carico_kg": 5000}]}, {})
    assert tuple(W.run_load(first, paths).first()) == (3, 1, 3, 7, 0)
    # the last workout gave no rows, so it is staged again and again adds nothing
    assert tuple(W.run_load(first, paths).first()) == (1, 3, 3, 0, 0)
    more = first.unionByName(source(spark, {"esercizi": [PLANK]}, first_id=4))
    assert tuple(W.run_load(more, paths).first()) == (2, 3, 4, 3, 0)
    assert spark.read.parquet(paths.target).count() == 10
    assert spark.read.parquet(paths.quarantine).count() == 1


def test_rows_left_in_staging_by_a_failed_run_are_not_staged_twice(spark, tmp_path):
    paths = W.LoadPaths(*[str(tmp_path / n) for n in ("staging", "target", "quarantine")])
    todo = source(spark, {"esercizi": [BENCH]}, {"esercizi": [PLANK]})
    W.to_raw(todo.filter("id = 1")).write.parquet(paths.staging)
    assert tuple(W.run_load(todo, paths).first()) == (2, 1, 2, 7, 0)


def test_rows_appended_before_a_crash_are_not_appended_again(spark, tmp_path):
    paths = W.LoadPaths(*[str(tmp_path / n) for n in ("staging", "target", "quarantine")])
    todo = source(spark, {"esercizi": [BENCH]}, {"esercizi": [PLANK]})
    W.run_load(todo, paths)
    W.to_raw(todo).write.mode("append").parquet(paths.staging)
    assert W.run_load(todo, paths).first().sets_written == 0
    assert spark.read.parquet(paths.target).count() == 7


def test_target_is_partitioned_by_month(spark, tmp_path):
    paths = W.LoadPaths(*[str(tmp_path / n) for n in ("staging", "target", "quarantine")])
    W.run_load(source(spark, {"esercizi": [BENCH]}), paths)
    assert (tmp_path / "target" / "ym=202405").is_dir()
    plan = spark.read.parquet(paths.target).filter("ym = 202405")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan


def test_a_first_load_parses_documents_once_and_joins_nothing(spark, tmp_path):
    raw = W.to_raw(source(spark, {"esercizi": [BENCH, {**PLANK, "recupero_secondi": 300}]}, {"esercizi": [{**BENCH, "serie": "4"}]}, " ", None))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in W.workout_sets(raw)]
    assert [plan.count("from_json") for plan in plans] == [1, 2]  # the quarantine is a union of two readings, which the load writes once
    sets, rejected = W.checked_documents(written(W.expand_documents(raw), "expanded"))
    assert all("from_json" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (sets, rejected))
    missing = W._table(spark, str(tmp_path / "none"), sets.schema)
    assert missing.schema.names == sets.schema.names and missing.count() == 0
    assert "Join" not in W.new_rows_only(sets, missing, "allenamento_id")._jdf.queryExecution().optimizedPlan().toString()
