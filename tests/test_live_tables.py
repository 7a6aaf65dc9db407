"""Streams over growing tables: increments by id, and samples against the starts and ends of sessions."""

import datetime as dt

from paceframe.runtime import scratch_path
from paceframe.sources.marked import MarkReader, marked_stream
from paceframe.streaming import jobs, sinks
from paceframe.streaming.admission import read_decided
from tests.conftest import rows

ROW = "id bigint, v bigint"
SAMPLE = "n bigint, session_id bigint, event_time timestamp"
MARK = "session_id bigint, at timestamp"


def _grow(spark, path, low, high):
    spark.range(low, high).selectExpr("id", "id * 2 AS v", "'x' AS unused").coalesce(2).write.mode("append").parquet(path)


def _stage(spark, source, stage, checkpoint):
    jobs.staging_job(marked_stream(spark, source, ROW, "id"), stage, checkpoint).awaitTermination()
    return rows(sinks.read_files(spark, stage, ROW))


def test_staging_grows_by_increments_and_survives_restarts(spark):
    source, stage, checkpoint = (scratch_path(spark, n) for n in ("source", "stage", "ck"))
    assert _stage(spark, source, stage, checkpoint) == []  # a missing folder is an empty stream
    for top in (10, 20):
        _grow(spark, source, top - 10, top)
        assert _stage(spark, source, stage, checkpoint) == sorted(((i, 2 * i) for i in range(top)), key=repr)
    assert len(_stage(spark, source, stage, checkpoint)) == 20
    sinks.forget_commits(spark, checkpoint)
    _grow(spark, source, 20, 25)
    assert len(_stage(spark, source, stage, checkpoint)) == 20  # the repeated batch keeps to its own marks
    assert _stage(spark, source, stage, checkpoint) == sorted(((i, 2 * i) for i in range(25)), key=repr)


def test_only_row_groups_between_the_marks_are_read(spark):
    source = scratch_path(spark, "source")
    for low in (0, 10, 20):
        _grow(spark, source, low, low + 10)
    nulls = spark.createDataFrame([(None, 1, "x")], "id bigint, v bigint, unused string")
    nulls.write.mode("append").parquet(source)
    reader = MarkReader(source, "id", ["v"])
    assert reader.latestOffset() == {"mark": 29}
    slices = reader.partitions({"mark": 9}, {"mark": 12})
    assert len(slices) == 1  # one of seven row groups: ids 10 to 14
    batches = [b for s in slices for b in reader.read(s)]
    assert [v for b in batches for v in b.column("v").to_pylist()] == [20, 22, 24] and batches[0].schema.names == ["v"]
    assert reader.partitions({"mark": 29}, {"mark": 29}) == []


def _at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


class Feed:
    """Three folders of small files that become three streams."""

    def __init__(self, spark):
        self.spark = spark
        self.paths = {n: scratch_path(spark, n) for n in ("samples", "starts", "ends", "out", "ck")}

    def send(self, samples=(), starts=(), ends=()):
        for name, data, schema in (("samples", samples, SAMPLE), ("starts", starts, MARK), ("ends", ends, MARK)):
            frame = self.spark.createDataFrame(list(data), schema).coalesce(1)
            frame.write.mode("append").parquet(self.paths[name])
        streams = [
            self.spark.readStream.schema(schema).parquet(self.paths[name])
            for name, schema in (("samples", SAMPLE), ("starts", MARK), ("ends", MARK))
        ]
        jobs.admission_job(*streams, self.paths["out"], self.paths["ck"], "60 MINUTES", "10 MINUTES", state_partitions=2).awaitTermination()
        found = read_decided(self.spark, self.paths["out"], f"{SAMPLE}, decision string", ["n"])
        return {r["n"]: r["decision"] for r in found.collect()}


def test_admission_over_batches_in_any_order(spark):
    feed = Feed(spark)
    # session 1 starts after its sample has come, 2 never does, 3 started before; a NULL id is unknown
    first = feed.send(
        samples=[(1, 1, _at(5)), (2, 2, _at(5)), (3, 3, _at(6)), (4, None, _at(5))], starts=[(3, _at(0)), (3, _at(0))], ends=[(99, _at(0))]
    )
    assert first == {3: "accepted"}
    second = feed.send(samples=[(5, 3, _at(9))], starts=[(1, _at(4))], ends=[(3, _at(8))])
    assert second == {3: "accepted", 1: "accepted", 5: "session_not_active"}
    # an end that is reported late takes back what was accepted after it, not what was before
    third = feed.send(samples=[(6, 1, _at(11))], ends=[(1, _at(10))])
    assert third == {**second, 6: "session_not_active"}
    # the watermark of all three passes the samples without a start
    last = feed.send(samples=[(7, 8, _at(100)), (8, 1, _at(70))], starts=[(8, _at(90)), (9, _at(100))], ends=[(9, _at(100))])
    last = feed.send(samples=[(9, 9, _at(130))], starts=[(10, _at(130))], ends=[(10, _at(130))])
    assert last == {**third, 2: "session_not_found", 4: "session_not_found", 7: "accepted", 8: "session_not_found", 9: "session_not_active"}


def test_live_decisions_equal_the_batch_operator(spark):
    from paceframe.operators.joins import accept_for_active

    samples = [(i, i % 9, _at(10 + i)) for i in range(40)]
    starts, ends = [(s, _at(0)) for s in range(9) if s % 4], [(s, _at(1)) for s in range(0, 9, 3)]
    feed = Feed(spark)
    feed.send(samples[::2], starts, ends)
    feed.send(samples[1::2])
    far = [(10**6, _at(500))]
    found = feed.send([(10**6, 10**6, _at(500))], far, far)
    found.pop(10**6, None)
    states = spark.createDataFrame([(s, "ended" if s % 3 == 0 else "active") for s in range(9) if s % 4], "session_id bigint, status string")
    accepted, rejected = accept_for_active(spark.createDataFrame(samples, SAMPLE), states)
    expected = {r["n"]: "accepted" for r in accepted.collect()} | {r["n"]: r["reason"] for r in rejected.collect()}
    assert found == expected


def test_starts_leave_the_state_and_admission_stays_a_stream(spark):
    feed = Feed(spark)
    feed.send([(1, 1, _at(0))], [(1, _at(0))], [(2, _at(0))])
    far = [(5, _at(300))]
    feed.send([(2, 5, _at(300))], far, far)
    feed.send([(3, 5, _at(301))])
    folder = f"{feed.paths['ck']}"
    joins = spark.read.format("state-metadata").load(folder).filter("operatorName = 'symmetricHashJoin'").select("operatorId").distinct()
    assert joins.count() == 2
    for operator in [r["operatorId"] for r in joins.collect()]:
        kept = spark.read.format("statestore").option("path", folder).option("operatorId", operator).option("joinSide", "right").load()
        assert {r[0] for r in kept.select("value._session").collect()} == {5}
