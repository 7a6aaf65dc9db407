"""Micro-batch sinks. A replayed batch overwrites its own folder, so each batch lands once."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from paceframe.operators.dedupe import latest_per_key
from paceframe.runtime import scratch_path, settings

BatchWriter = Callable[[DataFrame, int], None]


def parquet_sink(path: str) -> BatchWriter:
    """Append each non-empty batch below ``path/batch_id=N``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def json_sink(path: str) -> BatchWriter:
    """The same as JSON lines."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")

    return write


def routed_sink(routes: Mapping[str, tuple[Column, BatchWriter]]) -> BatchWriter:
    """Write the rows of each route with its own writer.

    The batch is cached while it is read once per route; the cache can be recomputed from
    the micro-batch when an executor is lost.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for condition, writer in routes.values():
                writer(batch.filter(condition), batch_id)
        finally:
            batch.unpersist()

    return write


def detector_sink(alerts_path: str, summaries_path: str) -> BatchWriter:
    """Alerts and session summaries of the detector, each to its own table."""
    alert = ["athlete_id", "session_id", "sample_index", "still_for", "latitude", "longitude", "heart_rate_bpm", "message"]
    summary = [
        "athlete_id", "session_id", "velocita_media", "velocita_max", "frequenza_cardiaca_media",
        "frequenza_cardiaca_max", "cadenza_media", "distanza_totale", "campioni", "durata_s", "end_reason",
    ]

    def narrowed(path: str, columns: list[str]) -> BatchWriter:
        sink = parquet_sink(path)
        return lambda batch, batch_id: sink(batch.select(*columns), batch_id)

    return routed_sink({
        "alert": (F.col("kind") == "alert", narrowed(alerts_path, alert)),
        "summary": (F.col("kind") == "summary", narrowed(summaries_path, summary)),
    })


def upsert_sink(path: str, keys: list[str], version: str) -> BatchWriter:
    """Each batch appends its newest row per key; readers take the newest over all batches.

    A batch costs its own size, not the size of the table.
    """
    write = parquet_sink(path)
    return lambda batch, batch_id: write(latest_per_key(batch, keys, [version]), batch_id)


def read_upserted(
    spark: SparkSession, path: str, schema: T.StructType, keys: list[str], newest: list[str]
) -> DataFrame:
    """Current rows of an upsert sink: the newest per key by ``newest``, then by batch."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    batches = spark.read.schema(with_batch).parquet(path)
    return latest_per_key(batches, keys, [*newest, "batch_id"]).drop("batch_id")


def compact(spark: SparkSession, path: str, target: str, schema: T.StructType, keys: list[str], newest: list[str]) -> None:
    """Write the current rows of an upsert sink as the first batch of a new folder."""
    read_upserted(spark, path, schema, keys, newest).write.parquet(f"{target}/batch_id=-1")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def state_settings(spark: SparkSession, partitions: int | None = None) -> dict[str, str]:
    """Settings of a stateful query, recorded in its checkpoint when it first starts.

    State is kept in RocksDB on executor disk with a changelog in the checkpoint, not on the
    heap. It is cut into one partition per core unless told otherwise: the number cannot
    change later, and the default of 200 is too many for one machine and too few for a
    thousand.
    """
    return {
        "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }


def start(df: DataFrame, writer: BatchWriter, name: str, checkpoint: str | None = None,
          interval: str | None = None, state_partitions: int | None = None) -> StreamingQuery:
    """Start a query with a checkpoint in shared storage.

    Without an interval it processes what is available, in as many batches as the source's
    caps demand, and stops.
    """
    return _started(df.writeStream.foreachBatch(writer), df.sparkSession, name, checkpoint, interval, state_partitions)


def start_files(df: DataFrame, path: str, by: list[str], name: str, checkpoint: str | None = None,
                interval: str | None = None, state_partitions: int | None = None) -> StreamingQuery:
    """Append to a Parquet table partitioned by the columns ``by``, each batch once.

    Tasks hand the names of their files to the driver, which adds a batch to the table's log when all are written;
    readers go by the log. A batch that is repeated after a crash finds itself in the log and adds nothing, and files of
    lost tasks are never read.
    """
    stream = df.writeStream.format("parquet").outputMode("append").partitionBy(*by).option("path", path)
    return _started(stream, df.sparkSession, name, checkpoint, interval, state_partitions)


def _started(stream: DataStreamWriter, spark: SparkSession, name: str, checkpoint: str | None, interval: str | None,
             state_partitions: int | None) -> StreamingQuery:
    stream = stream.option("checkpointLocation", checkpoint or scratch_path(spark, f"checkpoint-{name}"))
    stream = stream.trigger(processingTime=interval) if interval else stream.trigger(availableNow=True)
    with settings(spark, state_settings(spark, state_partitions)):  # the query keeps its own copy
        return stream.start()


def run_available(df: DataFrame, writer: BatchWriter, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Process everything available and wait for the end."""
    query = start(df, writer, name, checkpoint)
    query.awaitTermination()
    return query


def read_sink(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What a Parquet sink has written so far; empty before the first batch."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def read_files(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The committed batches of :func:`start_files`, partition columns included; empty before the first one."""
    if not _exists(spark, f"{path}/_spark_metadata"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def forget_commits(spark: SparkSession, checkpoint: str) -> None:
    """Make a stopped query run its last batch again when it next starts, as a crash between a batch's output and its commit does."""
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    commits.getFileSystem(spark._jsc.hadoopConfiguration()).delete(commits, True)
