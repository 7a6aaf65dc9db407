"""Declared schemas of every table, topic and document. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(),
    "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
    "binary": T.BinaryType(), "decimal(9,6)": T.DecimalType(9, 6), "decimal(5,2)": T.DecimalType(5, 2),
    "decimal(4,2)": T.DecimalType(4, 2),
}


def table_schema(columns: str, required: tuple[str, ...] = ()) -> T.StructType:
    """A struct type from ``name type`` pairs, built without a session so modules can be imported first."""
    pairs = [column.split(" ") for column in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind], name not in required) for name, kind in pairs])


RUNNING_SAMPLES = table_schema(
    "sample_id bigint, athlete_id bigint, session_id bigint, timestamp timestamp, heart_rate int, "
    "latitude decimal(9,6), longitude decimal(9,6), altitude decimal(5,2), temperature decimal(4,2), "
    "cadence int, event_type string, created_at timestamp",
    ("sample_id", "athlete_id", "session_id", "timestamp", "heart_rate"),
)
ANTHROPOMETRIC = table_schema(
    "athlete_id bigint, altezza_cm int, peso_kg decimal(5,2), data_rilevazione date",
    ("athlete_id", "data_rilevazione"),
)
ATHLETES = table_schema(
    "id bigint, nome string, cognome string, data_di_nascita date, sesso string, created_at timestamp",
    ("id", "nome", "cognome", "data_di_nascita"),
)
WORKOUTS = table_schema(
    "id bigint, athlete_id bigint, data_allenamento date, tipo_allenamento string, durata_minuti int, "
    "struttura_allenamento string, created_at timestamp",
    ("id", "athlete_id", "data_allenamento"),
)
WORKOUTS_RAW = table_schema(
    "allenamento_id bigint, athlete_id bigint, data_allenamento timestamp, "
    "struttura_allenamento string, created_at timestamp"
)
WORKOUT_SETS = table_schema(
    "allenamento_id bigint, athlete_id bigint, data_allenamento timestamp, nome_esercizio string, "
    "serie_allenamento int, ripetizioni_allenamento int, recupero_allenamento int, "
    "peso_allenamento decimal(5,2), created_at timestamp"
)
ENDURANCE_SAMPLES = table_schema(
    "atleta_id bigint, sessione_id bigint, secondo int, heart_rate_bpm double, cadence_spm double, "
    "speed_kmh double, altitude_m double, temperature_c double, ts timestamp"
)
METRICS_EVENT = table_schema(
    "athlete_id int, workout_id int, timestamp timestamp, power float, heart_rate int, cadence int, "
    "speed float, distance float"
)
WORKOUT_EVENT = table_schema("athlete_id int, workout_id int, date string, duration_minutes int, status string")
SESSION_SUMMARY = table_schema(
    "athlete_id string, session_id bigint, velocita_media double, velocita_max double, "
    "frequenza_cardiaca_media double, frequenza_cardiaca_max double, cadenza_media double, "
    "distanza_totale double, campioni bigint, durata_s double, end_reason string"
)
RUN_SUMMARY = table_schema(
    "id bigint, athlete_id bigint, velocita_media double, velocita_max double, frequenza_media double, "
    "frequenza_max double, cadenza double, distanza_km decimal(5,2), durata_minuti int, data_corsa date, "
    "created_at timestamp"
)
SMARTWATCH_SESSIONS = table_schema(
    "session_id bigint, athlete_id bigint, topic string, status string, samples_sent int, "
    "started_at timestamp, ended_at timestamp, end_reason string",
    ("session_id", "athlete_id", "topic", "status", "samples_sent", "started_at"),
)
WORKOUT_PLANS = table_schema(
    "plan_id string, athlete_code string, athlete_id int, session_type string, duration_min int, "
    "intensity int, notes string, phase string, target_load int, focus string, source string, "
    "created_at timestamp"
)
TRAINING_STATUS = table_schema(
    "athlete_id bigint, result_date date, status string, acwr double, hrv double, readiness double, "
    "trimp_7d double, injury_risk_pct double, created_at timestamp"
)
WEEKLY_CARDIO = table_schema("athlete_id bigint, week_id string, total_trimp double")
FORCE_PLATE_EVENT = table_schema(
    "athlete_id string, exercise string, left_foot_force_newtons double, right_foot_force_newtons double, "
    "total_force_newtons double, timestamp string, sample_index int"
)
EXERCISE_METRICS = table_schema(
    "athlete_id bigint, potenza_sviluppata double, rsi double, differenza_bilaterale double"
)
REQUEST_LOG = table_schema("request_id bigint, success boolean, status_code int, latency_ms double, error string")

# One record type that holds the fields of all heart-rate event dialects. Numbers are read as
# text so that a bad number is a quality finding of its field, not a lost record.
HR_EVENT_ANY = table_schema(
    "athlete_id string, atleta_id string, session_id string, sessione_id string, sport string, "
    "source string, heart_rate_bpm string, heart_rate string, cadence_spm string, cadence string, "
    "speed_kmh string, altitude_m string, altitude string, temperature_c string, temperature string, "
    "latitude string, longitude string, timestamp string, sample_index string, sample_id string, "
    "event_type string, _corrupt_record string"
)

# Workout document, both shapes: exercises at the top level with a set count, or nested below
# "allenamento" with one entry per set.
_COUNTED = table_schema("nome string, serie bigint, ripetizioni bigint, recupero_secondi bigint, carico_kg double")
_LISTED = T.StructType([
    T.StructField("nome", T.StringType()),
    T.StructField(
        "serie", T.ArrayType(table_schema("numero bigint, ripetizioni bigint, recupero_secondi bigint, carico_kg double"))
    ),
])
WORKOUT_DOCUMENT = T.StructType([
    T.StructField("tipo", T.StringType()),
    T.StructField("categoria", T.StringType()),
    T.StructField("esercizi", T.ArrayType(_COUNTED)),
    T.StructField("allenamento", T.StructType([T.StructField("esercizi", T.ArrayType(_LISTED))])),
])

KAFKA_RECORD = table_schema(
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"
)
