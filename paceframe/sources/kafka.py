"""Kafka records in and out. Needs Spark's Kafka connector on the class path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OFFSETS = ("latest", "earliest")


def starting_offsets(value: str | None) -> str:
    """``latest`` or ``earliest`` after trimming and lower-casing; anything else is an error."""
    chosen = (value or "latest").strip().lower()
    if chosen not in OFFSETS:
        raise ValueError(f"startingOffsets must be one of {OFFSETS}, not {value!r}")
    return chosen


def stream_options(servers: str, topic: str, offsets: str | None = None, max_per_trigger: int = 1_000_000) -> dict:
    """Options of a streaming read; the cap per trigger bounds the state work of one batch."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets(offsets),
        "maxOffsetsPerTrigger": str(max_per_trigger),
    }


def read_stream(
    spark: SparkSession, servers: str, topic: str, offsets: str | None = None, max_per_trigger: int = 1_000_000
) -> DataFrame:
    """An unbounded topic, at most ``max_per_trigger`` records per batch."""
    return spark.readStream.format("kafka").options(**stream_options(servers, topic, offsets, max_per_trigger)).load()


def read_bounded(spark: SparkSession, servers: str, topic: str, limit: int | None = None) -> DataFrame:
    """A topic from its beginning to its present end, optionally only ``limit`` records."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "endingOffsets": "latest",
    }
    records = spark.read.format("kafka").options(**options).load()
    return records if limit is None else records.limit(limit)


def to_records(df: DataFrame, key: Sequence[str], value: Column | None = None) -> DataFrame:
    """Key ``a-b`` and JSON value, ready for a Kafka sink."""
    body = F.to_json(F.struct("*")) if value is None else value
    return df.select(F.concat_ws("-", *[F.col(c).cast("string") for c in key]).alias("key"), body.alias("value"))


def enveloped(df: DataFrame, text: str) -> DataFrame:
    """Plain text in the one-field JSON envelope of the demo topic."""
    return df.select(F.to_json(F.struct(F.col(text).alias("event"))).alias("value"))


def write_records(records: DataFrame, servers: str, topic: str) -> None:
    """Publish a bounded frame of records."""
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
