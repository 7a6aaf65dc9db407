"""Rule-based quality checks: every row keeps the names of the rules it breaks."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe.functions.documents import parsed_once
from paceframe.functions.numbers import is_finite, parse_integer, parse_number
from paceframe.functions.text import one_of
from paceframe.schemas import HR_EVENT_ANY

Rules = Mapping[str, Column]


def all_present(columns: list[str]) -> Column:
    """All columns are non-NULL."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def with_reasons(df: DataFrame, rules: Rules, name: str = "reasons") -> DataFrame:
    """Add the array of broken rules; a condition that is NULL counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]
    return df.withColumn(name, F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the reasons, quarantined rows with them).

    Rows are split by plain conditions, which stay in generated code; the array of reasons
    is built for quarantined rows only.
    """
    ok = reduce(lambda a, b: a & b, [F.coalesce(rule, F.lit(False)) for rule in rules.values()])
    return df.filter(ok), with_reasons(df.filter(~ok), rules)


def positive_integer(x: Column) -> Column:
    """A whole number above zero."""
    return F.coalesce(parse_integer(x) > 0, F.lit(False))


def given(x: Column) -> Column:
    """Present and not empty."""
    return F.coalesce(F.trim(x.cast("string")) != "", F.lit(False))


def sample_rules() -> Rules:
    """Samples need finite heart rate, cadence, speed and altitude."""
    fields = ("heart_rate_bpm", "cadence_spm", "speed_kmh", "altitude_m")
    return {f"{f}_not_numeric": is_finite(F.col(f).cast("string").try_cast("double")) for f in fields}


def anthropometric_rules() -> Rules:
    """Exclusive bounds of the measurements table."""
    # 50 < height < 300 cm, 10 < weight < 500 kg.
    return {
        "altezza_cm_range": (F.col("altezza_cm") > 50) & (F.col("altezza_cm") < 300),
        "peso_kg_range": (F.col("peso_kg") > 10) & (F.col("peso_kg") < 500),
    }


def run_summary_rules() -> Rules:
    """Measures of a run are positive."""
    columns = ("velocita_media", "velocita_max", "frequenza_media", "frequenza_max", "cadenza",
               "distanza_km", "durata_minuti")
    return {f"{c}_not_positive": F.col(c) > 0 for c in columns}


def enumeration_rules(**allowed: tuple[str, ...]) -> Rules:
    """Membership of each named column in its list of values."""
    return {f"{c}_not_allowed": one_of(F.col(c), values) for c, values in allowed.items()}


# Enumerations of the operational tables and topics.
SEXES = ("M", "F")
WORKOUT_TYPES = ("forza", "endurance", "mobilità")
SESSION_STATES = ("active", "ended")
EXERCISES = ("squat", "jump", "leg_press")


def square_matrix_rule(columns: str = "columns", matrix: str = "matrix") -> Column:
    """At least two columns and a matrix of that many rows, each of that many values."""
    n = F.size(columns)
    rows_match = F.forall(matrix, lambda row: F.coalesce(F.size(row) == n, F.lit(False)))
    return F.coalesce((n >= 2) & (F.size(matrix) == n) & rows_match, F.lit(False))


def canonical_events(raw: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Heart-rate events of every dialect in one schema.

    Field aliases are coalesced, ``end`` becomes ``session_end`` and a missing type is a
    sample. ``malformed`` is true for text that is not a JSON object. Columns in ``keep``
    are carried along; they must not share a name with a field of the record.
    """
    parsed = parsed_once(
        raw, F.col(value).cast("string"), HR_EVENT_ANY, (*keep, F.col(value).cast("string").alias("raw"))
    )

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.col(n) for n in names])

    kind = F.lower(F.trim(F.col("event_type")))
    return parsed.select(
        *keep,
        pick("athlete_id", "atleta_id").alias("athlete_id"),
        parse_integer(pick("session_id", "sessione_id")).alias("session_id"),
        "sport",
        parse_number(pick("heart_rate_bpm", "heart_rate"), None).alias("heart_rate_bpm"),
        parse_number(pick("cadence_spm", "cadence"), None).alias("cadence_spm"),
        parse_number(F.col("speed_kmh"), None).alias("speed_kmh"),
        parse_number(pick("altitude_m", "altitude"), None).alias("altitude_m"),
        parse_number(pick("temperature_c", "temperature"), None).alias("temperature_c"),
        parse_number(F.col("latitude"), None).alias("latitude"),
        parse_number(F.col("longitude"), None).alias("longitude"),
        "timestamp",
        parse_integer(pick("sample_index", "sample_id")).alias("sample_index"),
        F.when(kind.isin("end", "session_end"), "session_end").otherwise("sample").alias("event_type"),
        (~given(F.col("raw")) | F.col("_corrupt_record").isNotNull()).alias("malformed"),
        "raw",
    )


def event_rules() -> Rules:
    """What a canonical event needs before it may reach the detector."""
    is_end = F.col("event_type") == "session_end"
    return {
        "malformed": ~F.col("malformed"),
        "athlete_id_missing": given(F.col("athlete_id")),
        "session_id_missing": F.col("session_id").isNotNull(),
        "sample_index_missing": F.col("sample_index").isNotNull(),
        "heart_rate_missing": is_end | F.col("heart_rate_bpm").isNotNull(),
    }


def enrich_samples(samples: DataFrame, base_index: Column | None = None) -> DataFrame:
    """Defaults of published samples; a missing index is the base index plus the position in the batch.

    ``position`` (0-based, within the session's batch) must be present when ``base_index`` is given.
    """
    index = parse_integer(F.col("sample_index"))
    if base_index is not None:
        index = F.coalesce(index, base_index + F.col("position"))
    # Defaults of missing fields.
    return samples.select(
        "athlete_id", "session_id",
        parse_number(F.col("heart_rate_bpm"), None).alias("heart_rate_bpm"),
        parse_number(F.col("cadence_spm"), None).alias("cadence_spm"),
        parse_number(F.col("speed_kmh"), None).alias("speed_kmh"),
        parse_number(F.col("altitude_m"), None).alias("altitude_m"),
        parse_number(F.col("temperature_c"), 20.0).alias("temperature_c"),
        index.alias("sample_index"),
        F.coalesce(F.col("timestamp"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.coalesce(F.col("source"), F.lit("frontend-sim")).alias("source"),
        F.coalesce(F.col("sport"), F.lit("running_endurance")).alias("sport"),
    )
