"""From broker records to typed, checked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.functions.documents import parsed_once
from paceframe.operators.quality import canonical_events, event_rules, given, split_valid


def decode(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of a JSON value with a declared schema; a malformed value gives NULL fields."""
    return parsed_once(records, F.col("value").cast("string"), schema)


def decode_strict(records: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(typed rows, dead letters): text that is not JSON never stops the stream.

    The corrupt-record column tells malformed text from an object without known fields.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    text = F.col("value").cast("string")
    parsed = parsed_once(records, text, with_corrupt, [text.alias("raw")])
    bad = ~given(F.col("raw")) | F.col("_corrupt_record").isNotNull()
    return parsed.filter(~bad).select(*schema.names), parsed.filter(bad).select("raw")


def heart_rate_events(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical events of all dialects with ``event_time``, dead letters with reasons)."""
    events = canonical_events(records).withColumn("event_time", F.try_to_timestamp(F.col("timestamp")))
    rules = {**event_rules(), "timestamp_missing": F.col("event_time").isNotNull()}
    valid, dead = split_valid(events, rules)
    return valid.drop("malformed", "raw"), dead.select("raw", "reasons")


def without_redelivery(events: DataFrame, late_by: str = "10 minutes", same_time: bool = False) -> DataFrame:
    """Drop repeated deliveries of a sample that arrive within the lateness bound.

    With ``same_time`` only records of one event time are the same, so a session that starts
    again after its end marker may count its samples from the beginning.
    """
    keyed = events.withWatermark("event_time", late_by)
    same = ["athlete_id", "session_id", "sample_index", "event_type"]
    return keyed.dropDuplicatesWithinWatermark([*same, "event_time"] if same_time else same)
