"""Source options, and the physical plans that matter at scale."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from paceframe.operators import dedupe, timeseries
from paceframe.plans import training_status
from paceframe.registry import adapters as A
from paceframe.runtime import shared_dir, written
from paceframe.schemas import WORKOUT_PLANS
from paceframe.sources import files, jdbc, kafka


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_jdbc_options():
    db = jdbc.Database("jdbc:x://host/db", "me", "secret", "org.x.Driver", extra={"ssl": "true"})
    split = jdbc.Split("id", 0, 1000, 20)
    assert jdbc.read_options(db, "samples", split) == {
        "url": "jdbc:x://host/db", "user": "me", "password": "secret", "driver": "org.x.Driver", "ssl": "true", "dbtable": "samples",
        "fetchsize": "10000", "partitionColumn": "id", "lowerBound": "0", "upperBound": "1000", "numPartitions": "20"}
    assert "partitionColumn" not in jdbc.read_options(db, "samples")


def test_incremental_scan(spark):
    df = spark.range(10)
    assert rows(jdbc.incremental_scan(df, "id", 7)) == [(8,), (9,)]
    assert rows(jdbc.incremental_scan(df, "id", spark.range(9).agg(F.max("id")))) == [(9,)]


def test_kafka_options():
    assert kafka.starting_offsets(" Earliest ") == "earliest" and kafka.starting_offsets(None) == "latest"
    with pytest.raises(ValueError):
        kafka.starting_offsets("5")
    assert kafka.stream_options("h:1", "t")["maxOffsetsPerTrigger"] == "1000000"


def test_records(spark):
    df = spark.createDataFrame([(1, 2, "à")], "a int, b int, c string")
    assert rows(kafka.to_records(df, ["a", "b"])) == [("1-2", '{"a":1,"b":2,"c":"à"}')]


def test_missing_table(spark):
    assert files.table_or_empty(spark, "nothing_here", WORKOUT_PLANS).count() == 0
    with pytest.raises(LookupError):
        files.require_table(spark, "nothing_here")


def test_bucketed_join_needs_no_exchange(spark, sf):
    files.write_bucketed(A.table(spark, sf, "orders"), "bucketed_orders", "o_custkey", 8)
    files.write_bucketed(A.table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "bucketed_customer", "o_custkey", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_orders").join(spark.table("bucketed_customer"), "o_custkey")
        assert "Exchange" not in plan(joined) and joined.count() == 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert written(spark.range(3), "t").inputFiles()[0].startswith("file://" + shared_dir(spark))


def test_top_one_per_key_is_limited_before_the_shuffle(spark, sf):
    text = plan(dedupe.latest_per_key(A.training_status(spark, sf), ["athlete_id"], ["result_date"]))
    before_exchange = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in before_exchange and "Partial" in before_exchange


def test_ordinary_sessions_are_shuffled_once(spark, sf):
    text = plan(timeseries.crisis_points(A.running_samples(spark, sf)))
    plain = text[text.index("Union"):]
    branch = plain[:plain.index("BroadcastExchange")]
    assert len(re.findall(r"Exchange hashpartitioning", branch)) == 1
    assert "REPARTITION" in branch


def test_scans_read_only_what_is_needed(spark, sf):
    text = plan(training_status.mean_index(A.endurance_samples(spark, sf), F.lit("2024-02-25").cast("date")))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in text
    assert len(re.findall("Exchange hashpartitioning", text)) <= 2


def test_point_lookup_reaches_the_scan(spark, sf):
    df = A.athletes(spark, sf).filter(F.col("athlete_id") == 42)
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,42)]" in plan(df)


def test_monthly_table_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-31"), (2, "2024-02-01")], "id int, d string").select("id", F.to_timestamp("d").alias("ts"))
    for _ in range(2):
        files.write_monthly(df, str(tmp_path / "m"), "ts", ["id"])
    assert rows(spark.read.parquet(str(tmp_path / "m")), "ym", "id") == [(202401, 1), (202401, 1), (202402, 2), (202402, 2)]


def test_day_cut_of_the_mean_index_reaches_the_scan(spark, sf, tmp_path):
    A.endurance_samples(spark, sf).write.parquet(str(tmp_path / "samples"))
    found = training_status.mean_index(spark.read.parquet(str(tmp_path / "samples")), F.lit("2024-02-25").cast("date"))
    assert "GreaterThanOrEqual(ts" in found._jdf.queryExecution().toString()
