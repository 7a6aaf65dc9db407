"""JSON text in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_json(text: Column, schema: T.StructType) -> Column:
    """Typed parse of JSON text; unknown fields are ignored, a malformed text gives NULL fields."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})


def compact_json(value: Column) -> Column:
    """A struct as compact JSON text; a NULL struct is the empty object."""
    return F.coalesce(F.to_json(value), F.lit("{}"))


def parsed_once(df: DataFrame, text: Column, schema: T.StructType, keep: Sequence[str | Column] = ()) -> DataFrame:
    """``keep`` plus the fields of the JSON text as columns, parsed exactly once per row.

    Filters on parsed fields would otherwise be pushed below the projection and parse the
    text again for every field they mention; the optimiser moves nothing below a generator.
    """
    return df.select(*keep, F.inline(F.array(parse_json(text, schema))))
