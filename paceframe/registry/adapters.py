"""Telemetry views of the driver tables, once for Spark and once as SQL for the check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.runtime import scratch_path

TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    return spark.readStream.schema(TABLES[name]).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def second(ts: Column) -> Column:
    """A timestamp as text to the second."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def with_views(body: str, *names: str) -> str:
    """SQL text with the named views in front."""
    wanted: list[str] = []
    for name in names:
        for needed in (*NEEDS.get(name, ()), name):
            if needed not in wanted:
                wanted.append(needed)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted) + "\n" + body


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance as SQL text."""
    h = (
        f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    )
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({h}), sqrt(CASE WHEN {h} > 1 THEN 0 ELSE 1 - {h} END)))"


def _epoch() -> Column:
    return F.lit("2024-01-01").cast("date")


def _week(ts: str) -> Column:
    return F.floor(F.datediff(F.to_date(ts), _epoch()) / 7).cast("bigint")


def _bpm() -> Column:
    return (F.lit(110) + F.floor("value") % 80).cast("int")


def running_samples(spark: SparkSession, sf: str) -> DataFrame:
    """GPS and heart-rate samples; a session is a user's week. Some come again later with another value, some lack one."""
    samples = table(spark, sf, "events").select(
        F.col("event_id").alias("sample_id"),
        (F.col("user_id") + 1).alias("athlete_id"),
        _week("ts").alias("session_id"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_id") % 53 != 3, _bpm()).alias("heart_rate"),
        (F.lit(42.9) + (F.col("event_id") % 97) * F.lit(0.0001)).alias("latitude"),
        (F.lit(12.7) + (F.col("event_id") % 89) * F.lit(0.0001)).alias("longitude"),
        (F.lit(150) + F.col("event_id") % 40).cast("int").alias("cadence"),
        F.lit("sample").alias("event_type"),
    )
    later = F.col("timestamp") + F.expr("INTERVAL 1 SECOND")
    again = samples.filter("sample_id % 50 = 7").withColumns({"timestamp": later, "heart_rate": F.lit(99)})
    return samples.unionByName(again.select(*samples.columns))


def anthropometric(spark: SparkSession, sf: str) -> DataFrame:
    """Body measurements, ten per athlete on different days."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        (F.floor(key / 10) + 1).cast("bigint").alias("athlete_id"),
        F.date_add(_epoch(), ((key * 7) % 30).cast("int")).alias("data_rilevazione"),
        (F.lit(150) + key % 45).cast("int").alias("altezza_cm"),
        (F.lit(50) + (key * 7) % 60).cast("double").alias("peso_kg"),
    )


def athletes(spark: SparkSession, sf: str) -> DataFrame:
    """Athletes; every seventh has no surname."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("athlete_id"),
        F.col("c_mktsegment").alias("nome"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("cognome"),
    )


def workouts(spark: SparkSession, sf: str) -> DataFrame:
    """Workout plans, one document per line item, in all document shapes and some broken ones.

    The JSON is built per row from the line item, so no group of rows is ever collected.
    """
    line = table(spark, sf, "lineitem")
    reps = F.col("l_quantity").cast("bigint")
    load = F.floor("l_extendedprice") / 100
    name = F.concat("l_returnflag", "l_linestatus")
    main = F.struct(
        name.alias("nome"),
        (F.col("l_linenumber") - 1).alias("serie"),
        reps.alias("ripetizioni"),
        (F.lit(30) + (F.col("l_partkey") % 24) * 10).alias("recupero_secondi"),
        load.alias("carico_kg"),
    )
    missing = {k: F.lit(None).cast("bigint").alias(k) for k in ("ripetizioni", "carico_kg")}
    plank = F.struct(
        F.lit("Plank").alias("nome"), F.lit(2).alias("serie"), missing["ripetizioni"],
        F.lit(40).cast("bigint").alias("recupero_secondi"), F.lit(None).cast("double").alias("carico_kg"),
    )
    both = F.when(F.col("l_suppkey") % 3 == 0, F.array(main, plank)).otherwise(F.array(main))
    flat = F.to_json(F.struct(F.lit("palestra").alias("tipo"), both.alias("esercizi")))
    listed_set = F.transform(
        F.sequence(F.lit(1), F.col("l_linenumber")),
        lambda i: F.struct(i.alias("numero"), reps.alias("ripetizioni"), load.alias("carico_kg")),
    )
    listed = F.to_json(
        F.struct(F.struct(F.array(F.struct(name.alias("nome"), listed_set.alias("serie"))).alias("esercizi")).alias("allenamento"))
    )
    key = F.col("l_orderkey")
    document = (
        F.when(key % 50 == 0, F.lit(None))
        .when(key % 51 == 0, F.lit("{}"))
        .when(key % 53 == 0, F.lit('{"tipo":"palestra","eser'))
        .when(key % 47 == 0, listed)
        .otherwise(flat)
    )
    return line.select(
        key.alias("id"),
        (F.col("l_suppkey") + 1).alias("athlete_id"),
        F.col("l_shipdate").alias("data_allenamento"),
        document.alias("struttura_allenamento"),
        F.col("l_shipdate").alias("created_at"),
    )


def endurance_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Endurance samples."""
    key = F.col("event_id")
    return table(spark, sf, "events").select(
        (F.col("user_id") + 1).alias("atleta_id"),
        _week("ts").alias("sessione_id"),
        ((key * 30) % 3600).cast("int").alias("secondo"),
        _bpm().cast("double").alias("heart_rate_bpm"),
        (F.lit(7) + key % 12).cast("double").alias("speed_kmh"),
        (F.lit(15) + key % 10).cast("double").alias("temperature_c"),
        "ts",
    )


def training_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status history per athlete."""
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "Green").when(F.col("o_orderstatus") == "P", "RED")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("athlete_id"),
        F.to_date("o_orderdate").alias("result_date"),
        key.alias("created_at"),
        status.alias("status"),
        F.round(F.col("o_totalprice") / 200000, 4).alias("acwr"),
        (F.lit(40) + key % 37).cast("double").alias("hrv"),
        (key % 101).cast("double").alias("readiness"),
        (key % 400).cast("double").alias("trimp_7d"),
        (key % 61).cast("double").alias("injury_risk_pct"),
    )


def daily_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Training load of an athlete on a day."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("athlete_id"), F.col("l_shipdate").alias("day"), F.col("l_quantity").alias("load")
    )


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with their latency."""
    ok = F.col("event_type") != "error"
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        ok.alias("success"),
        F.when(ok, 200).otherwise(500).alias("status_code"),
        F.col("value").alias("latency_ms"),
        F.when(~ok, F.concat(F.lit("failed "), F.col("props"))).alias("error"),
    )


def workout_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Submitted plans; no intensity on the 13th of a month."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("AT-"), F.lpad((key % 1000).cast("string"), 3, "0")).alias("athlete_code"),
        F.when(F.dayofmonth("o_orderdate") != 13, key % 10).alias("intensity"),
        F.when(key % 7 != 0, key % 4000).alias("target_load"),
        F.col("o_orderdate").alias("created_at"),
    )


def smartwatch_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions; every third has ended."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        (key + 1).alias("session_id"),
        F.when(key % 3 == 0, "ended").otherwise("active").alias("status"),
        (key % 5).alias("samples_sent"),
    )


def force_plate(spark: SparkSession, sf: str) -> DataFrame:
    """Force-plate samples."""
    kind = F.col("event_id") % 3
    return table(spark, sf, "events").select(
        (F.col("user_id") + 1).cast("string").alias("athlete_id"),
        F.when(kind == 0, "squat").when(kind == 1, "jump").otherwise("leg_press").alias("exercise"),
        (F.col("value") + 200).alias("left_foot_force_newtons"),
        (F.col("value") + 180 + F.col("event_id") % 40).alias("right_foot_force_newtons"),
        F.lit(None).cast("double").alias("total_force_newtons"),
    )


def event_json(events: DataFrame) -> DataFrame:
    """Heart-rate records as JSON text in column ``value``: two dialects, end markers and bad text."""
    key = F.col("event_id")
    when = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    common = [
        (F.col("user_id") + 1).cast("string").alias("athlete_id"),
        (_week("ts") + 1).alias("session_id"),
        (F.lit(42.9) + (F.floor(key / 2000) % 7) * F.lit(0.0005)).alias("latitude"),
        F.lit(12.7).alias("longitude"),
        when.alias("timestamp"),
    ]
    bpm = F.when(key % 31 != 0, _bpm())
    end = key % 401 == 0
    cadence = (F.lit(150) + key % 40).alias("cadence_spm")
    first = F.to_json(F.struct(*common, key.alias("sample_index"), bpm.alias("heart_rate_bpm"), cadence,
                               (F.lit(100) + key % 50).alias("altitude_m")))
    other = F.to_json(F.struct(*common, key.alias("sample_id"), bpm.alias("heart_rate"), cadence.alias("cadence"),
                               F.lit("sample").alias("event_type")))
    marker = F.to_json(F.struct(common[0], common[1], common[4], key.alias("sample_index"),
                                F.when(key % 2 == 0, "end").otherwise("session_end").alias("event_type")))
    text = F.when(end, marker).when(key % 50 == 0, F.lit('{"athlete_id":"')).when(key % 29 == 0, other).otherwise(first)
    return events.select(text.alias("value"))


def shuffled_records(spark: SparkSession, sf: str, days: int = 5) -> DataFrame:
    """The heart-rate records as a stream that brings them out of order, up to ``days`` and six hours late, each twice or once."""
    path = scratch_path(spark, "records")
    events = table(spark, sf, "events")
    sent = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(6 * 3600))
    again = F.when(F.col("event_id") % 17 == 0, F.array(F.lit(0), F.lit(3600))).otherwise(F.array(F.lit(0)))
    sliced = events.withColumn("later", F.explode(again)).withColumn("slice", F.floor((sent + F.col("later")) / (days * 86400)))
    for at in [r["slice"] for r in sliced.select("slice").distinct().orderBy("slice").collect()]:  # a few: the table covers a month
        event_json(sliced.where(F.col("slice") == at)).write.mode("append").text(path)
    return spark.readStream.option("maxFilesPerTrigger", 1).text(path)


def live_samples(events: DataFrame) -> DataFrame:
    """Samples with the session they claim to belong to, one session per user."""
    return events.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("event_time"))


def session_marks(customers: DataFrame, ended: bool) -> DataFrame:
    """Starts of the sessions, some never begun, or the ends of every third of them."""
    key = F.col("c_custkey")
    day = key % 28 + (F.when(key % 4 == 0, 1).otherwise(5) if ended else F.lit(0))
    at = F.date_add(_epoch(), day.cast("int")).cast("timestamp")
    marks = customers.filter(key % 3 == 0) if ended else customers.filter(key % 7 != 0)
    return marks.select(key.alias("session_id"), at.alias("at"))


def metric_json(events: DataFrame) -> DataFrame:
    """Power and speed records as JSON text."""
    key = F.col("event_id")
    record = F.struct(
        (F.col("user_id") % 50 + 1).alias("athlete_id"),
        key.alias("workout_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        (F.lit(100) + key % 200).alias("power"),
        _bpm().alias("heart_rate"),
        (F.lit(60) + key % 40).alias("cadence"),
        (F.lit(5) + key % 8).alias("speed"),
        (key % 1000).alias("distance"),
    )
    text = F.when(key % 50 == 0, F.lit('{"athlete_id":')).otherwise(F.to_json(record))
    return events.select(text.alias("value"))


def workout_json(orders: DataFrame) -> DataFrame:
    """Workout events as JSON text."""
    record = F.struct(
        F.col("o_custkey").alias("athlete_id"),
        F.col("o_orderkey").alias("workout_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        (F.col("o_orderkey") % 120).alias("duration_minutes"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("cancelled").alias("status"),
    )
    return orders.select(F.to_json(record).alias("value"))


_SQL_BPM = "CAST(110 + CAST(floor(value) AS BIGINT) % 80 AS INTEGER)"
_SQL_WEEK = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS BIGINT)"

VIEWS = {
    "running_samples": f"""
        SELECT event_id AS sample_id, user_id + 1 AS athlete_id, {_SQL_WEEK} AS session_id, ts + to_seconds(again) AS "timestamp",
               CASE WHEN again = 1 THEN 99 WHEN event_id % 53 <> 3 THEN {_SQL_BPM} END AS heart_rate,
               42.9::DOUBLE + (event_id % 97) * 0.0001::DOUBLE AS latitude,
               12.7::DOUBLE + (event_id % 89) * 0.0001::DOUBLE AS longitude,
               CAST(150 + event_id % 40 AS INTEGER) AS cadence, 'sample' AS event_type
        FROM events CROSS JOIN (VALUES (0), (1)) copies(again) WHERE again = 0 OR event_id % 50 = 7""",
    "clean_samples": """
        SELECT * FROM (SELECT * FROM running_samples QUALIFY row_number() OVER (PARTITION BY athlete_id, session_id, sample_id ORDER BY "timestamp") = 1)
        WHERE heart_rate IS NOT NULL""",
    "anthropometric": """
        SELECT c_custkey // 10 + 1 AS athlete_id, DATE '2024-01-01' + CAST((c_custkey * 7) % 30 AS INTEGER) AS data_rilevazione,
               CAST(150 + c_custkey % 45 AS INTEGER) AS altezza_cm, CAST(50 + (c_custkey * 7) % 60 AS DOUBLE) AS peso_kg
        FROM customer""",
    "athletes": """
        SELECT c_custkey AS athlete_id, c_mktsegment AS nome, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS cognome
        FROM customer""",
    # exercises as rows, without the detour over JSON
    "exercises": """
        SELECT *, CAST(l_quantity AS BIGINT) AS reps, 30 + (l_partkey % 24) * 10 AS rest,
               floor(l_extendedprice) / 100 AS load, l_returnflag || l_linestatus AS nome
        FROM lineitem
        WHERE l_orderkey % 50 <> 0 AND l_orderkey % 51 <> 0 AND l_orderkey % 53 <> 0""",
    "all_sets": """
        SELECT l_orderkey AS allenamento_id, l_suppkey + 1 AS athlete_id, l_shipdate AS data_allenamento,
               nome, unnest(generate_series(1, l_linenumber - 1)) AS serie, reps AS ripetizioni, rest AS recupero, load AS carico
        FROM exercises WHERE l_orderkey % 47 <> 0
        UNION ALL
        SELECT l_orderkey, l_suppkey + 1, l_shipdate, 'Plank', unnest([1, 2]), 0, 40, 0.0
        FROM exercises WHERE l_orderkey % 47 <> 0 AND l_suppkey % 3 = 0
        UNION ALL
        SELECT l_orderkey, l_suppkey + 1, l_shipdate, nome, unnest(generate_series(1, l_linenumber)), reps, 0, load
        FROM exercises WHERE l_orderkey % 47 = 0""",
    "good_sets": """
        SELECT * FROM all_sets
        WHERE ripetizioni BETWEEN 0 AND 255 AND recupero BETWEEN 0 AND 255 AND abs(carico) <= 999.99""",
    "endurance_samples": f"""
        SELECT user_id + 1 AS atleta_id, {_SQL_WEEK} AS sessione_id, CAST((event_id * 30) % 3600 AS INTEGER) AS secondo,
               CAST({_SQL_BPM} AS DOUBLE) AS heart_rate_bpm, CAST(7 + event_id % 12 AS DOUBLE) AS speed_kmh,
               CAST(15 + event_id % 10 AS DOUBLE) AS temperature_c, ts
        FROM events""",
    "training_status": """
        SELECT o_custkey AS athlete_id, CAST(o_orderdate AS DATE) AS result_date, o_orderkey AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'Green' WHEN 'P' THEN 'RED' END AS status,
               round(o_totalprice / 200000, 4) AS acwr, CAST(40 + o_orderkey % 37 AS DOUBLE) AS hrv,
               CAST(o_orderkey % 101 AS DOUBLE) AS readiness, CAST(o_orderkey % 400 AS DOUBLE) AS trimp_7d,
               CAST(o_orderkey % 61 AS DOUBLE) AS injury_risk_pct
        FROM orders""",
    "daily_loads": "SELECT l_suppkey AS athlete_id, l_shipdate AS day, l_quantity AS load FROM lineitem",
    "weekly_cardio": """
        SELECT athlete_id, isoyear(day) || '-' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0') AS week_id,
               sum(load) AS total_trimp
        FROM daily_loads GROUP BY ALL""",
    "request_log": """
        SELECT event_id AS request_id, event_type <> 'error' AS success,
               CASE WHEN event_type <> 'error' THEN 200 ELSE 500 END AS status_code, value AS latency_ms,
               CASE WHEN event_type = 'error' THEN 'failed ' || props END AS error
        FROM events""",
    "workout_plans": """
        SELECT 'AT-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS athlete_code,
               CASE WHEN day(o_orderdate) <> 13 THEN o_orderkey % 10 END AS intensity,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 4000 END AS target_load, o_orderdate AS created_at
        FROM orders""",
    "smartwatch_sessions": """
        SELECT c_custkey + 1 AS session_id, CASE WHEN c_custkey % 3 = 0 THEN 'ended' ELSE 'active' END AS status,
               c_custkey % 5 AS samples_sent
        FROM customer""",
    "force_plate": """
        SELECT CAST(user_id + 1 AS VARCHAR) AS athlete_id,
               CASE event_id % 3 WHEN 0 THEN 'squat' WHEN 1 THEN 'jump' ELSE 'leg_press' END AS exercise,
               value + 200 AS l, value + 180 + event_id % 40 AS r
        FROM events""",
    # the records of event_json after canonicalisation
    "hr_records": f"""
        SELECT event_id, event_id % 401 = 0 AS is_end, event_id % 401 <> 0 AND event_id % 50 = 0 AS malformed,
               CAST(user_id + 1 AS VARCHAR) AS athlete_id, {_SQL_WEEK} + 1 AS session_id, event_id AS sample_index, ts,
               CASE WHEN event_id % 31 <> 0 THEN CAST({_SQL_BPM} AS DOUBLE) END AS bpm,
               CAST(150 + event_id % 40 AS DOUBLE) AS cadence,
               42.9::DOUBLE + ((event_id // 2000) % 7) * 0.0005::DOUBLE AS lat, 12.7::DOUBLE AS lon
        FROM events""",
    "hr_samples": "SELECT * FROM hr_records WHERE NOT is_end AND NOT malformed AND bpm IS NOT NULL",
    "metric_events": f"""
        SELECT user_id % 50 + 1 AS athlete_id, date_trunc('microsecond', ts) AS ts, CAST(100 + event_id % 200 AS DOUBLE) AS power,
               {_SQL_BPM} AS heart_rate, CAST(5 + event_id % 8 AS DOUBLE) AS speed, CAST(event_id % 1000 AS DOUBLE) AS distance
        FROM events WHERE event_id % 50 <> 0""",
    "features": f"""
        SELECT *, speed / mean_hr AS efficiency FROM (
            SELECT *, avg(speed) OVER frame AS mean_speed, avg(heart_rate) OVER frame AS mean_hr FROM (
                SELECT *, {sql_haversine("plat", "plon", "latitude", "longitude")} / 5.0::DOUBLE AS speed FROM (
                    SELECT *, lag(latitude) OVER s AS plat, lag(longitude) OVER s AS plon FROM clean_samples
                    WINDOW s AS (PARTITION BY athlete_id, session_id ORDER BY sample_id)))
            WINDOW frame AS (PARTITION BY athlete_id, session_id ORDER BY sample_id ROWS BETWEEN 60 PRECEDING AND CURRENT ROW))""",
    "drift": """
        SELECT *, round((efficiency - baseline) / nullif(baseline, 0) * 100, 9) AS drift_pct FROM (
            SELECT *, first_value(efficiency IGNORE NULLS) OVER (PARTITION BY athlete_id, session_id ORDER BY sample_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS baseline FROM features)""",
    "crisis": """
        SELECT * FROM drift WHERE drift_pct > 5
        QUALIFY row_number() OVER (PARTITION BY athlete_id, session_id ORDER BY "timestamp", sample_id) = 1""",
    "newest_status": """
        SELECT * FROM training_status QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY result_date DESC, created_at DESC) = 1""",
    "population": """
        SELECT c.*, m.peso_kg, m.altezza_cm, m.peso_kg / (m.altezza_cm * m.altezza_cm / 10000.0::DOUBLE) AS bmi,
               (SELECT count(DISTINCT session_id) FROM crisis k WHERE k.athlete_id = c.athlete_id) AS numero_corse
        FROM crisis c JOIN anthropometric m ON m.athlete_id = c.athlete_id AND m.data_rilevazione = CAST(c."timestamp" AS DATE)""",
    "endurance_days": """
        SELECT CAST(atleta_id AS VARCHAR) AS atleta, CAST(ts AS DATE) AS giorno, max(CAST(secondo AS DOUBLE)) AS max_durata,
               avg(speed_kmh / 3.6::DOUBLE) AS media_velocita, avg(heart_rate_bpm) AS media_freq_cardiaca,
               max(secondo * (speed_kmh / 3.6::DOUBLE)) AS max_distanza, avg(temperature_c) AS temperatura
        FROM endurance_samples GROUP BY ALL""",
    "endurance_index": """
        SELECT *, media_freq_cardiaca / nullif(max_durata, 0) / nullif(media_velocita, 0) / nullif(temperatura, 0) AS idx
        FROM endurance_days""",
}

NEEDS = {
    "newest_status": ("training_status",),
    "all_sets": ("exercises",),
    "good_sets": ("exercises", "all_sets"),
    "weekly_cardio": ("daily_loads",),
    "hr_samples": ("hr_records",),
    "clean_samples": ("running_samples",),
    "features": ("running_samples", "clean_samples"),
    "drift": ("running_samples", "clean_samples", "features"),
    "crisis": ("running_samples", "clean_samples", "features", "drift"),
    "population": ("running_samples", "clean_samples", "anthropometric", "features", "drift", "crisis"),
    "endurance_days": ("endurance_samples",),
    "endurance_index": ("endurance_samples", "endurance_days"),
}
