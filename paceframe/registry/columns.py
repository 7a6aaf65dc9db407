"""Projections, filters, quality rules and scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceframe.functions import dates, documents, geo, numbers, text
from paceframe.operators import quality
from paceframe.operators.skew import dense_position
from paceframe.plans import dashboard, training_status
from paceframe.registry import CATALOGUE as C
from paceframe.registry import adapters as A
from paceframe.registry.adapters import with_views
from paceframe.schemas import METRICS_EVENT


@C.add("B1_cast_rename", with_views("""
    SELECT CAST(atleta_id AS VARCHAR) AS atleta, CAST(CAST(ts AS DATE) AS VARCHAR) AS giorno,
           round(heart_rate_bpm, 6) AS "frequenza cardiaca", round(speed_kmh / 3.6::DOUBLE, 6) AS "velocità",
           CAST(secondo AS DOUBLE) AS durata, temperature_c AS temperatura
    FROM endurance_samples""", "endurance_samples"))
def _(spark, sf):
    return training_status.projected(A.endurance_samples(spark, sf)).select(
        "atleta", F.col("giorno").cast("string").alias("giorno"), F.round("frequenza cardiaca", 6).alias("frequenza cardiaca"),
        F.round("velocità", 6).alias("velocità"), "durata", "temperatura",
    )


@C.add("B2_unit_conversion", with_views("""
    SELECT round(sum(secondo * (speed_kmh / 3.6::DOUBLE)), 3) AS metres, round(max(speed_kmh / 3.6::DOUBLE), 6) AS top_speed,
           atleta_id AS athlete_id
    FROM endurance_samples GROUP BY atleta_id""", "endurance_samples"))
def _(spark, sf):
    p = training_status.projected(A.endurance_samples(spark, sf))
    return p.groupBy(F.col("atleta").cast("bigint").alias("athlete_id")).agg(
        F.round(F.sum("distanza"), 3).alias("metres"), F.round(F.max("velocità"), 6).alias("top_speed")
    )


@C.add("B3_required_columns", """
    SELECT l_orderkey AS allenamento_id, count(*) AS n FROM lineitem
    WHERE l_orderkey % 50 <> 0 AND l_shipdate IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    w = A.workouts(spark, sf).filter(quality.all_present(["id", "struttura_allenamento", "data_allenamento"]))
    return w.groupBy(F.col("id").alias("allenamento_id")).agg(F.count(F.lit(1)).alias("n"))


@C.add("B4_point_lookup", with_views("""
    SELECT athlete_id, nome, cognome FROM athletes WHERE athlete_id = 42""", "athletes"))
def _(spark, sf):
    return A.athletes(spark, sf).filter(F.col("athlete_id") == 42).limit(1)


@C.add("B5_threshold_filters", with_views("""
    SELECT atleta, CAST(giorno AS VARCHAR) AS giorno, round(max_distanza, 6) AS max_distanza FROM endurance_days
    WHERE max_distanza > 500 AND date_diff('day', giorno, DATE '2024-02-15') <= 42""", "endurance_days"))
def _(spark, sf):
    as_of = F.lit("2024-02-15").cast("date")
    days = training_status.athlete_days(A.endurance_samples(spark, sf))
    near = days.filter((F.col("max_distanza") > 500) & (dates.days_between(as_of, F.col("giorno")) <= 42))
    return near.select("atleta", F.col("giorno").cast("string").alias("giorno"), F.round("max_distanza", 6).alias("max_distanza"))


@C.add("B6_bmi", with_views("""
    SELECT athlete_id, CAST(data_rilevazione AS VARCHAR) AS day,
           round(peso_kg / (altezza_cm * altezza_cm / 10000.0::DOUBLE), 6) AS bmi
    FROM anthropometric""", "anthropometric"))
def _(spark, sf):
    return A.anthropometric(spark, sf).select(
        "athlete_id", F.col("data_rilevazione").cast("string").alias("day"),
        F.round(numbers.bmi(F.col("peso_kg"), F.col("altezza_cm")), 6).alias("bmi"),
    )


@C.add("B7_pruned_non_empty", "SELECT doc_id, lang FROM documents WHERE trim(text) <> '' AND lang <> ''")
def _(spark, sf):
    docs = A.table(spark, sf, "documents")
    return docs.filter((F.trim("text") != "") & (F.col("lang") != "")).select("doc_id", "lang")


@C.add("B8_status_recommendation", with_views("""
    SELECT created_at, lower(coalesce(status, 'amber')) AS status,
           CASE lower(coalesce(status, 'amber')) WHEN 'red' THEN 'Recupero attivo' WHEN 'amber' THEN 'Carico controllato'
                ELSE 'Sessione progressiva' END AS next_session
    FROM training_status""", "training_status"))
def _(spark, sf):
    status = F.lower(F.coalesce(F.col("status"), F.lit("amber")))
    return A.training_status(spark, sf).select(
        "created_at", status.alias("status"), dashboard.recommendation(status).alias("next_session")
    )


@C.add("B9_heart_rate_zone", with_views("""
    SELECT sample_id, CASE WHEN heart_rate < 120 THEN 'z1_recovery' WHEN heart_rate < 140 THEN 'z2_aerobic'
           WHEN heart_rate < 160 THEN 'z3_tempo' WHEN heart_rate < 175 THEN 'z4_threshold' WHEN heart_rate IS NOT NULL THEN 'z5_vo2max' END AS zone
    FROM running_samples""", "running_samples"))
def _(spark, sf):
    return A.running_samples(spark, sf).select("sample_id", numbers.heart_rate_zone(F.col("heart_rate")).alias("zone"))


def _web_samples(spark, sf):
    """Samples as text, some with numbers that are none, missing or infinite."""
    key = F.col("event_id")
    e = A.table(spark, sf, "events")
    return e.select(
        key.alias("sample_index"), F.col("user_id").alias("session_id"), (F.col("user_id") + 1).alias("athlete_id"),
        F.when(key % 11 == 0, "n/a").when(key % 13 != 0, F.col("value").cast("string")).alias("heart_rate_bpm"),
        F.when(key % 17 == 0, "Infinity").otherwise((key % 40).cast("string")).alias("cadence_spm"),
        F.when(key % 19 == 0, "NaN").otherwise((key % 12).cast("string")).alias("speed_kmh"),
        (key % 50).cast("string").alias("altitude_m"),
        F.when(key % 3 == 0, (key % 30).cast("string")).alias("temperature_c"),
        F.when(key % 5 == 0, "2024-01-01T00:00:00Z").otherwise("2024-01-02T00:00:00Z").alias("timestamp"),
        F.when(key % 7 == 0, "watch").alias("source"), F.lit(None).cast("string").alias("sport"),
    )


@C.add("B10_sample_quarantine", """
    SELECT event_id AS sample_index, concat_ws(',',
             CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'heart_rate_bpm_not_numeric' END,
             CASE WHEN event_id % 17 = 0 THEN 'cadence_spm_not_numeric' END,
             CASE WHEN event_id % 19 = 0 THEN 'speed_kmh_not_numeric' END) AS reasons
    FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0""")
def _(spark, sf):
    _, bad = quality.split_valid(_web_samples(spark, sf), quality.sample_rules())
    return bad.select("sample_index", F.array_join("reasons", ",").alias("reasons"))


@C.add("B10_first_bad_index", """
    SELECT user_id AS session_id, min(event_id) AS first_bad FROM events
    WHERE event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0 GROUP BY user_id""")
def _(spark, sf):
    _, bad = quality.split_valid(_web_samples(spark, sf), quality.sample_rules())
    return bad.groupBy("session_id").agg(F.min("sample_index").alias("first_bad"))


@C.add("B11_required_and_members", """
    SELECT event_id, concat_ws(',',
             CASE WHEN event_id % 8 = 0 THEN 'athlete_id' END, CASE WHEN event_id % 9 IN (0, 1) THEN 'session_id' END,
             CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'exercise' END) AS reasons
    FROM events""")
def _(spark, sf):
    key = F.col("event_id")
    e = A.table(spark, sf, "events").select(
        "event_id", "event_type",
        F.when(key % 8 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("athlete"),
        F.when(key % 9 == 0, "1.5").when(key % 9 == 1, "-3").otherwise((key + 1).cast("string")).alias("session"),
    )
    rules = {
        "athlete_id": quality.given(F.col("athlete")),
        "session_id": quality.positive_integer(F.col("session")),
        "exercise": text.one_of(F.col("event_type"), ("view", "click", "purchase")),
    }
    return quality.with_reasons(e, rules).select("event_id", F.array_join("reasons", ",").alias("reasons"))


@C.add("B12_domain_checks", """
    SELECT c_custkey, concat_ws(',', CASE WHEN NOT (c_custkey % 300 + 20 > 50 AND c_custkey % 300 + 20 < 300) THEN 'altezza_cm_range' END,
             CASE WHEN NOT (c_custkey % 510 > 10 AND c_custkey % 510 < 500) THEN 'peso_kg_range' END,
             CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment_not_allowed' END) AS reasons
    FROM customer""")
def _(spark, sf):
    key = F.col("c_custkey")
    c = A.table(spark, sf, "customer").withColumns({"altezza_cm": key % 300 + 20, "peso_kg": key % 510})
    rules = {**quality.anthropometric_rules(), **quality.enumeration_rules(c_mktsegment=("BUILDING", "MACHINERY"))}
    return quality.with_reasons(c, rules).select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


@C.add("B13_enriched_samples", """
    SELECT user_id AS session_id,
           100 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample_index,
           CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 30 AS DOUBLE) ELSE 20.0::DOUBLE END AS temperature_c,
           CASE WHEN event_id % 7 = 0 THEN 'watch' ELSE 'frontend-sim' END AS source, 'running_endurance' AS sport,
           CASE WHEN event_id % 5 = 0 THEN '2024-01-01T00:00:00Z' ELSE '2024-01-02T00:00:00Z' END AS "timestamp"
    FROM events""")
def _(spark, sf):
    placed = dense_position(_web_samples(spark, sf), ["session_id"], "sample_index", "position")
    missing = placed.withColumn("sample_index", F.lit(None).cast("string"))
    done = quality.enrich_samples(missing, F.lit(100))
    return done.select("session_id", "sample_index", "temperature_c", "source", "sport", "timestamp")


@C.add("B14_complete_rows", """
    SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND day(o_orderdate) <> 13""")
def _(spark, sf):
    keyed = A.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.dayofmonth("o_orderdate") != 13, 1).alias("intensity"),
        F.when(F.col("o_orderkey") % 7 != 0, 1).alias("target_load"),
    )
    return keyed.na.drop(subset=["intensity", "target_load"]).select("o_orderkey")


@C.add("B15_canonical_events", with_views("""
    SELECT athlete_id, session_id, sample_index, CASE WHEN is_end THEN 'session_end' ELSE 'sample' END AS event_type,
           CASE WHEN NOT is_end THEN bpm END AS heart_rate_bpm, CASE WHEN NOT is_end THEN cadence END AS cadence_spm
    FROM hr_records WHERE NOT malformed""", "hr_records"))
def _(spark, sf):
    events = quality.canonical_events(A.event_json(A.table(spark, sf, "events")))
    return events.filter(~F.col("malformed")).select(
        "athlete_id", "session_id", "sample_index", "event_type", "heart_rate_bpm", "cadence_spm"
    )


@C.add("B16_single_join_column", """
    SELECT o_custkey AS custkey, count(*) AS n, max(c_acctbal) AS acctbal
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey""")
def _(spark, sf):
    orders = A.table(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey")
    customer = A.table(spark, sf, "customer").withColumnRenamed("c_custkey", "custkey")
    joined = orders.join(customer, orders["custkey"] == customer["custkey"]).drop(customer["custkey"])
    return joined.groupBy("custkey").agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("acctbal"))


@C.add("B17_square_matrix", """
    SELECT c_custkey, CASE WHEN c_custkey % 4 IN (2, 3) AND c_custkey % 5 <> 0 THEN 1 ELSE 0 END AS ok FROM customer""")
def _(spark, sf):
    n = (F.col("c_custkey") % 4).cast("int")
    row_length = F.when(F.col("c_custkey") % 5 == 0, n + 1).otherwise(n)
    c = A.table(spark, sf, "customer").select(
        "c_custkey", F.array_repeat(F.lit("x"), n).alias("columns"),
        F.array_repeat(F.array_repeat(F.lit(0.5), row_length), n).alias("matrix"),
    )
    return c.select("c_custkey", quality.square_matrix_rule().cast("int").alias("ok"))


@C.add("B18_normalised_choice", """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'relational' WHEN 1 THEN 'analytical' WHEN 2 THEN 'analytical'
           WHEN 3 THEN 'relational' END AS destination
    FROM events""")
def _(spark, sf):
    key = F.col("event_id") % 5
    raw = F.when(key == 0, "  Relational ").when(key == 1, "CH").when(key == 2, "analytical").when(key == 4, "other")
    aliases = {"relational": "relational", "analytical": "analytical", "ch": "analytical"}
    return A.table(spark, sf, "events").select(
        "event_id", text.normalise_choice(raw, aliases, "relational").alias("destination")
    )


@C.add("H1_haversine", with_views(f"""
    SELECT sample_id, round({A.sql_haversine("latitude", "longitude", "42.9556::DOUBLE", "12.7031::DOUBLE")}, 4) AS metres
    FROM running_samples""", "running_samples"))
def _(spark, sf):
    d = geo.haversine_m(F.col("latitude"), F.col("longitude"), F.lit(42.9556), F.lit(12.7031))
    return A.running_samples(spark, sf).select("sample_id", F.round(d, 4).alias("metres"))


@C.add("H3_speed_efficiency", with_views("""
    SELECT sample_id, round(speed, 6) AS speed_ms, round(efficiency, 6) AS efficiency FROM features""", "features"))
def _(spark, sf):
    from paceframe.operators.timeseries import session_features

    f = session_features(A.running_samples(spark, sf))
    return f.select("sample_id", F.round("speed_ms", 6).alias("speed_ms"), F.round("efficiency", 6).alias("efficiency"))


@C.add("H6_rounding_and_clamp", """
    SELECT event_id, CAST(floor(value / 7 + 0.5::DOUBLE) AS BIGINT) AS daily, round(value / 7, 2) AS two_places,
           least(greatest(value - 250, -100.0::DOUBLE), 100.0::DOUBLE) AS clamped, abs(event_id - 5000) AS distance,
           CAST((event_id * 30) // 300 AS BIGINT) AS bucket
    FROM events""")
def _(spark, sf):
    v = F.col("value")
    return A.table(spark, sf, "events").select(
        "event_id", numbers.round_half_up(v / 7).cast("bigint").alias("daily"), F.round(v / 7, 2).alias("two_places"),
        numbers.clamp(v - 250, -100.0, 100.0).alias("clamped"), F.abs(F.col("event_id") - 5000).alias("distance"),
        F.expr("(event_id * 30) div 300").alias("bucket"),
    )


@C.add("H8_number_parsing", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 7.0::DOUBLE WHEN 2 THEN 7.0::DOUBLE ELSE 7.0::DOUBLE END AS parsed
    FROM events""")
def _(spark, sf):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "abc").when(k == 2, "Infinity")
    return A.table(spark, sf, "events").select("event_id", numbers.parse_number(raw, 7.0).alias("parsed"))


@C.add("H10_codes_and_names", with_views("""
    SELECT athlete_id, 'AT-' || CASE WHEN athlete_id > 999 THEN CAST(athlete_id AS VARCHAR)
             ELSE lpad(CAST(athlete_id AS VARCHAR), 3, '0') END AS code,
           coalesce(nome, '') || ' ' || coalesce(cognome, '') AS name,
           nullif(TRY_CAST(regexp_extract('AT-' || lpad(CAST(athlete_id % 1000 AS VARCHAR), 3, '0') || 'x', '([0-9]+)', 1) AS BIGINT), 0) AS parsed,
           athlete_id || '-' || (athlete_id + 1) AS key
    FROM athletes""", "athletes"))
def _(spark, sf):
    i = F.col("athlete_id")
    padded = F.concat(F.lit("AT-"), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit("x"))
    return A.athletes(spark, sf).select(
        "athlete_id", text.athlete_code(i).alias("code"), text.full_name(F.col("nome"), F.col("cognome")).alias("name"),
        text.first_positive_int(padded).alias("parsed"), text.session_key(i, i + 1).alias("key"),
    )


@C.add("H14_alarm_text", with_views("""
    SELECT sample_id, format('Atleta {} fermo da {} s in posizione {:.6f}, {:.6f} (bpm {})', athlete_id, sample_id % 90,
                             latitude, longitude, coalesce(CAST(heart_rate AS VARCHAR), '')) AS message
    FROM running_samples""", "running_samples"))
def _(spark, sf):
    s = A.running_samples(spark, sf)
    m = text.alarm_text(
        F.col("athlete_id").cast("string"), F.col("sample_id") % 90, F.col("latitude"), F.col("longitude"),
        F.col("heart_rate").cast("double"),
    )
    return s.select("sample_id", m.alias("message"))


@C.add("H16_dates_and_weeks", """
    SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS ym,
           isoyear(o_orderdate) || '-' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week_id,
           CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS monday,
           CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS age_days,
           CAST(dayofweek(o_orderdate) AS INTEGER) AS dow,
           ['Dom', 'Lun', 'Mar', 'Mer', 'Gio', 'Ven', 'Sab'][dayofweek(o_orderdate) + 1] AS day
    FROM orders""")
def _(spark, sf):
    d = F.to_date("o_orderdate")
    week = dates.iso_week_id(d)
    return A.table(spark, sf, "orders").select(
        "o_orderkey", dates.month_number(F.col("o_orderdate")).alias("ym"), week.alias("week_id"),
        dates.iso_week_monday(week).cast("string").alias("monday"),
        dates.days_between(F.lit("2002-01-01").cast("date"), d).alias("age_days"),
        dates.weekday_number(d).alias("dow"), dates.weekday_name(dates.weekday_number(d)).alias("day"),
    )


@C.add("H20_iso_timestamps", """
    SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = F.when(F.col("event_id") % 9 != 0, iso).otherwise("yesterday")
    return A.table(spark, sf, "events").select("event_id", A.second(dates.parse_iso(raw)).alias("parsed"))


@C.add("H21_json_fields", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event_id":' || event_id || '}' AS compact FROM events""")
def _(spark, sf):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("k bigint")
    return A.table(spark, sf, "events").select(
        "event_id", documents.parse_json(F.col("props"), schema)["k"].alias("k"),
        documents.compact_json(F.struct("event_id")).alias("compact"),
    )


@C.add("H22_typed_records", with_views("""
    SELECT athlete_id, count(*) AS n, round(avg(power), 6) AS power, max(heart_rate) AS heart_rate FROM metric_events
    GROUP BY athlete_id""", "metric_events"))
def _(spark, sf):
    from paceframe.streaming.ingest import decode

    rows = decode(A.metric_json(A.table(spark, sf, "events")), METRICS_EVENT).filter(F.col("workout_id").isNotNull())
    return rows.groupBy(F.col("athlete_id").cast("bigint").alias("athlete_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("power"), 6).alias("power"), F.max("heart_rate").alias("heart_rate")
    )


@C.add("H25_checked_casts", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity * 10 <= 255 THEN CAST(l_quantity * 10 AS INTEGER) END AS small,
           CASE WHEN floor(l_extendedprice) / 100 <= 999.99 THEN floor(l_extendedprice) / 100 END AS load
    FROM lineitem""")
def _(spark, sf):
    small, load = F.col("l_quantity") * 10, F.floor("l_extendedprice") / 100
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", numbers.checked_cast(small, 0, 255, "int").alias("small"),
        numbers.checked_cast(load, -999.99, 999.99, "decimal(5,2)").cast("double").alias("load"),
    )


@C.add("H28_duration_pattern", """
    SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 1 ELSE 0 END AS ok FROM events""")
def _(spark, sf):
    k = F.col("event_id") % 4
    n = F.col("event_id").cast("string")
    raw = F.when(k == 0, F.concat(n, F.lit("s"))).when(k == 1, F.concat(F.lit(" "), n, F.lit("m "))).when(k == 2, F.concat(n, F.lit("d")))
    return A.table(spark, sf, "events").select("event_id", text.is_duration(raw).cast("int").alias("ok"))


@C.add("L11_plan_forms", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'AT-002' ELSE 'AT-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS athlete_code,
           CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE nullif(o_orderkey % 1000, 0) END AS athlete_id,
           CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 4000 = 0 THEN 3200.0::DOUBLE ELSE CAST(o_orderkey % 4000 AS DOUBLE) END AS target_load,
           CAST(floor(CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 4000 = 0 THEN 3200.0::DOUBLE ELSE CAST(o_orderkey % 4000 AS DOUBLE) END / 7 + 0.5::DOUBLE) AS BIGINT) AS estimated_daily_load
    FROM orders""")
def _(spark, sf):
    key = F.col("o_orderkey")
    code = F.concat(F.lit("AT-"), F.lpad((key % 1000).cast("string"), 3, "0"))
    forms = A.table(spark, sf, "orders").select(
        "o_orderkey", F.when(key % 4 != 0, code).alias("athlete"),
        F.when(key % 5 == 0, "much").otherwise((key % 4000).cast("string")).alias("target_load"),
        F.lit(None).cast("string").alias("phase"), F.lit("").alias("focus"),
    )
    plans = dashboard.weekly_plans(forms.select("athlete", "target_load", "phase", "focus", "o_orderkey"), keep=("o_orderkey",))
    return plans.select("o_orderkey", "athlete_code", "athlete_id", "target_load", "estimated_daily_load")
