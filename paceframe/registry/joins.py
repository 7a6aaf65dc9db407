"""Joins and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceframe.functions.numbers import ratio
from paceframe.operators import dedupe, joins
from paceframe.operators.timeseries import crisis_points
from paceframe.plans import dashboard
from paceframe.registry import CATALOGUE as C
from paceframe.registry import adapters as A
from paceframe.registry.adapters import with_views


@C.add("C1_inner_join_key", """
    SELECT o_custkey AS athlete_id, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def _(spark, sf):
    orders = A.table(spark, sf, "orders").withColumnRenamed("o_custkey", "athlete_id")
    customer = A.table(spark, sf, "customer").withColumnRenamed("c_custkey", "athlete_id")
    joined = orders.join(customer, "athlete_id")
    return joined.groupBy("athlete_id", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@C.add("C2_join_key_and_date", with_views("""
    SELECT c.athlete_id, c.session_id, c.sample_id, CAST(m.data_rilevazione AS VARCHAR) AS day, m.peso_kg, m.altezza_cm
    FROM crisis c JOIN anthropometric m ON m.athlete_id = c.athlete_id AND m.data_rilevazione = CAST(c."timestamp" AS DATE)
    """, "crisis", "anthropometric"))
def _(spark, sf):
    found = joins.join_same_day(
        crisis_points(A.running_samples(spark, sf)), joins.with_bmi(A.anthropometric(spark, sf))
    )
    return found.select(
        "athlete_id", "session_id", "sample_id", F.col("data_rilevazione").cast("string").alias("day"), "peso_kg", "altezza_cm"
    )


@C.add("C3_left_join_counts", """
    SELECT c_custkey AS athlete_id, coalesce(n, 0) AS n
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey""")
def _(spark, sf):
    big = A.table(spark, sf, "orders").filter("o_totalprice > 400000")
    counts = big.groupBy(F.col("o_custkey").alias("athlete_id")).agg(F.count(F.lit(1)).alias("n"))
    people = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("athlete_id"))
    return people.join(counts, ["athlete_id"], "left").select("athlete_id", F.coalesce("n", F.lit(0)).alias("n"))


@C.add("C4_lateral_newest", with_views("""
    SELECT a.athlete_id, t.status, t.acwr, t.readiness, CAST(t.result_date AS VARCHAR) AS result_date
    FROM athletes a LEFT JOIN newest_status t ON t.athlete_id = a.athlete_id""", "athletes", "newest_status"))
def _(spark, sf):
    found = joins.with_latest(
        A.athletes(spark, sf), A.training_status(spark, sf), "athlete_id", ["result_date", "created_at"]
    )
    return found.select("athlete_id", "status", "acwr", "readiness", F.col("result_date").cast("string").alias("result_date"))


@C.add("C5_latest_week", with_views("""
    SELECT athlete_id, week_id, total_trimp FROM weekly_cardio WHERE week_id = (SELECT max(week_id) FROM weekly_cardio)
    """, "weekly_cardio"))
def _(spark, sf):
    from paceframe.operators.rollups import weekly_load

    return joins.rows_at_maximum(weekly_load(A.daily_loads(spark, sf), "day", "load"), "week_id")


@C.add("C6_one_session_of_athlete", with_views("""
    SELECT sample_id, session_id, heart_rate FROM running_samples
    WHERE athlete_id = 9 AND session_id = (SELECT min(session_id) FROM running_samples WHERE athlete_id = 9)
    """, "running_samples"))
def _(spark, sf):
    return joins.first_session_samples(A.running_samples(spark, sf), 9).select("sample_id", "session_id", "heart_rate")


@C.add("C7_unnest_exercises", with_views("""
    SELECT l_orderkey AS allenamento_id, nome, count(*) AS n FROM (
        SELECT l_orderkey, nome FROM exercises WHERE l_orderkey % 47 <> 0
        UNION ALL SELECT l_orderkey, 'Plank' FROM exercises WHERE l_orderkey % 47 <> 0 AND l_suppkey % 3 = 0)
    GROUP BY ALL""", "exercises"))
def _(spark, sf):
    from paceframe.functions.documents import parse_json
    from paceframe.schemas import WORKOUT_DOCUMENT

    doc = A.workouts(spark, sf).select("id", parse_json(F.col("struttura_allenamento"), WORKOUT_DOCUMENT).alias("d"))
    rows = doc.select(F.col("id").alias("allenamento_id"), F.explode("d.esercizi").alias("e"))
    return rows.groupBy("allenamento_id", F.col("e.nome").alias("nome")).agg(F.count(F.lit(1)).alias("n"))


@C.add("C8_unnest_set_range", with_views("""
    SELECT allenamento_id, nome, serie, count(*) AS n FROM all_sets GROUP BY ALL""", "all_sets"))
def _(spark, sf):
    from paceframe.plans.workout_elt import expand_sets, to_raw

    sets = expand_sets(to_raw(A.workouts(spark, sf)))
    return sets.groupBy("allenamento_id", "nome", "serie").agg(F.count(F.lit(1)).alias("n"))


@C.add("C9_enrich_and_average", """
    SELECT s_nationkey AS nation, round(avg(l_quantity), 6) AS mean_quantity, round(avg(l_discount), 6) AS mean_discount
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey""")
def _(spark, sf):
    facts = A.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "key")
    people = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    means = joins.enrich_and_average(
        facts, people, "key", ["nation"], {"mean_quantity": F.col("l_quantity"), "mean_discount": F.col("l_discount")}
    )
    return means.select("nation", F.round("mean_quantity", 6).alias("mean_quantity"), F.round("mean_discount", 6).alias("mean_discount"))


@C.add("C10_as_of_measurement", with_views("""
    SELECT s.sample_id, CAST(m.data_rilevazione AS VARCHAR) AS measured, m.peso_kg
    FROM running_samples s ASOF LEFT JOIN anthropometric m
      ON m.athlete_id = s.athlete_id AND CAST(s."timestamp" AS DATE) >= m.data_rilevazione""", "running_samples", "anthropometric"))
def _(spark, sf):
    found = joins.join_as_of(
        A.running_samples(spark, sf), A.anthropometric(spark, sf).select("athlete_id", "data_rilevazione", "peso_kg"),
        "timestamp", "data_rilevazione",
    )
    return found.select("sample_id", F.col("data_rilevazione").cast("string").alias("measured"), "peso_kg")


@C.add("C11_new_rows_only", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def _(spark, sf):
    loaded = A.table(spark, sf, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    return joins.new_rows_only(A.table(spark, sf, "lineitem"), loaded, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


def _samples_for_sessions(spark, sf):
    # twice as many session ids as there are sessions, so some are unknown
    return A.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 2 + 1).alias("session_id"))


@C.add("C12_accepted_samples", with_views("""
    SELECT o_orderkey, o_custkey * 2 + 1 AS session_id FROM orders
    WHERE o_custkey * 2 + 1 IN (SELECT session_id FROM smartwatch_sessions WHERE status = 'active')""", "smartwatch_sessions"))
def _(spark, sf):
    return joins.accept_for_active(_samples_for_sessions(spark, sf), A.smartwatch_sessions(spark, sf))[0]


@C.add("C12_rejected_samples", with_views("""
    SELECT o_orderkey, o_custkey * 2 + 1 AS session_id,
           CASE WHEN s.session_id IS NULL THEN 'session_not_found' ELSE 'session_not_active' END AS reason
    FROM orders LEFT JOIN smartwatch_sessions s ON s.session_id = o_custkey * 2 + 1
    WHERE s.status IS DISTINCT FROM 'active'""", "smartwatch_sessions"))
def _(spark, sf):
    return joins.accept_for_active(_samples_for_sessions(spark, sf), A.smartwatch_sessions(spark, sf))[1]


@C.add("G1_union_of_summaries", """
    SELECT 'quantity' AS metric, round(sum(l_quantity), 2) AS total, count(*) AS n FROM lineitem
    UNION ALL SELECT 'discount', round(sum(l_discount), 2), count(*) FROM lineitem
    UNION ALL SELECT 'tax', round(sum(l_tax), 2), count(*) FROM lineitem""")
def _(spark, sf):
    metrics = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}
    # one pass, then one row per metric: a union would scan the table once per metric
    sums = A.table(spark, sf, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 2).alias(m) for m, c in metrics.items()]
    )
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("total"), F.col("n")) for m in metrics]
    return sums.select(F.inline(F.array(*rows)))


@C.add("G2_first_of_duplicates", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def _(spark, sf):
    slim = A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return dedupe.first_per_key(slim, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).drop("l_shipdate")


@C.add("G3_unique_athlete_day", """
    SELECT o_custkey AS athlete_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL""")
def _(spark, sf):
    rows = A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("athlete_id"), F.to_date("o_orderdate").cast("string").alias("day"), "o_orderkey"
    )
    return dedupe.latest_per_key(rows, ["athlete_id", "day"], ["o_orderkey"])


@C.add("L11_training_status", with_views("""
    SELECT a.athlete_id, 'AT-' || CASE WHEN a.athlete_id > 999 THEN CAST(a.athlete_id AS VARCHAR)
             ELSE lpad(CAST(a.athlete_id AS VARCHAR), 3, '0') END AS id,
           a.nome || ' ' || coalesce(a.cognome, '') AS name, lower(coalesce(n.status, 'amber')) AS status,
           coalesce(n.acwr, 0.0) AS acwr, coalesce(CAST(n.readiness AS INTEGER), 0) AS readiness,
           CASE lower(coalesce(n.status, 'amber')) WHEN 'red' THEN 'Recupero attivo' WHEN 'amber' THEN 'Carico controllato'
                ELSE 'Sessione progressiva' END AS next_session
    FROM athletes a LEFT JOIN newest_status n ON n.athlete_id = a.athlete_id""", "athletes", "newest_status"))
def _(spark, sf):
    return dashboard.training_status(A.athletes(spark, sf), A.training_status(spark, sf))


@C.add("D1_group_means", """
    SELECT s_nationkey, round(avg(l_quantity), 6) AS avg_l_quantity, round(avg(l_extendedprice), 4) AS avg_l_extendedprice,
           round(avg(asym), 6) AS avg_asym
    FROM (SELECT *, l_discount / nullif(l_tax, 0) AS asym FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def _(spark, sf):
    from paceframe.operators.rollups import group_means

    line = A.table(spark, sf, "lineitem").withColumn("asym", ratio(F.col("l_discount"), F.col("l_tax")))
    joined = line.join(A.table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    means = group_means(joined, ["s_nationkey"], ["l_quantity", "l_extendedprice", "asym"])
    return means.select(
        "s_nationkey", F.round("avg_l_quantity", 6).alias("avg_l_quantity"),
        F.round("avg_l_extendedprice", 4).alias("avg_l_extendedprice"), F.round("avg_asym", 6).alias("avg_asym"),
    )
