"""Sources and sinks, each written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceframe.functions.dates import month_number
from paceframe.operators import dedupe, joins
from paceframe.plans import workout_elt
from paceframe.registry import CATALOGUE as C
from paceframe.registry import adapters as A
from paceframe.registry.adapters import with_views
from paceframe.registry.aggregates import WORDS
from paceframe.runtime import scratch_path
from paceframe.schemas import WORKOUT_PLANS
from paceframe.sources import files, kafka
from paceframe.sources.jdbc import incremental_scan


@C.add("A5_text_source", WORDS)
def _(spark, sf):
    from paceframe.operators.rollups import word_counts

    path = scratch_path(spark, "text")
    A.table(spark, sf, "documents").select("text").write.text(path)
    return word_counts(files.read_text(spark, path))


@C.add("A6_incremental_scan", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_orderkey > (SELECT coalesce(max(l_orderkey), 0) FROM lineitem WHERE l_shipdate < DATE '1995-02-01')""")
def _(spark, sf):
    from paceframe.operators.rollups import high_water_mark

    line = A.table(spark, sf, "lineitem")
    loaded = line.filter(F.col("l_shipdate") < F.lit("1995-02-01").cast("timestamp_ntz"))
    fresh = incremental_scan(line, "l_orderkey", high_water_mark(loaded, "l_orderkey"))
    return fresh.select("l_orderkey", "l_linenumber", "l_partkey")


@C.add("A7_keyed_json_records", """
    SELECT (user_id + 1) || '-' || event_id AS key,
           '{"athlete_id":' || (user_id + 1) || ',"session_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value
    FROM events""")
def _(spark, sf):
    rows = A.table(spark, sf, "events").select(
        (F.col("user_id") + 1).alias("athlete_id"), F.col("event_id").alias("session_id"), "event_type"
    )
    return kafka.to_records(rows, ["athlete_id", "session_id"])


@C.add("A7_enveloped_text", """SELECT '{"event":"' || event_type || '"}' AS value, count(*) AS n FROM events GROUP BY 1""")
def _(spark, sf):
    return kafka.enveloped(A.table(spark, sf, "events"), "event_type").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@C.add("A11_json_lines", """SELECT event_id, user_id, event_type, value FROM events""")
def _(spark, sf):
    path = scratch_path(spark, "json-lines")
    rows = A.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    files.append_json_lines(rows, path)
    return files.read_json_lines(spark, path, rows.schema)


@C.add("A12_monthly_table", """
    SELECT CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS ym, l_orderkey, l_linenumber, l_partkey FROM lineitem""")
def _(spark, sf):
    path = scratch_path(spark, "monthly")
    line = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    files.write_monthly(line, path, "l_shipdate", ["l_shipdate", "l_orderkey"])
    back = spark.read.schema("l_orderkey bigint, l_linenumber int, l_partkey bigint, ym int").parquet(path)
    return back.select("ym", "l_orderkey", "l_linenumber", "l_partkey")


@C.add("A12_month_pruned_read", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate >= DATE '1997-03-01' AND l_shipdate < DATE '1997-04-01'""")
def _(spark, sf):
    path = scratch_path(spark, "monthly")
    line = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    files.write_monthly(line, path, "l_shipdate", ["l_shipdate", "l_orderkey"])
    back = spark.read.schema("l_orderkey bigint, l_linenumber int, l_partkey bigint, ym int").parquet(path)
    return back.filter("ym = 199703").drop("ym")


@C.add("A13_hash_distributed", """
    SELECT athlete_id, count(*) AS n FROM (SELECT l_suppkey AS athlete_id FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    spread = files.distribute(A.daily_loads(spark, sf), "athlete_id", 16)
    # the grouping reuses the distribution: no further exchange
    return spread.groupBy("athlete_id").agg(F.count(F.lit(1)).alias("n"))


@C.add("A14_staging_emptied", "SELECT 0::BIGINT AS left_in_staging, count(*) AS staged FROM lineitem")
def _(spark, sf):
    path = scratch_path(spark, "staging")
    raw = workout_elt.to_raw(A.workouts(spark, sf))
    files.write_table(raw, path)
    staged = spark.read.schema(raw.schema).parquet(path).count()
    files.truncate(spark, path, raw.schema)
    left = spark.read.schema(raw.schema).parquet(path)
    return left.agg(F.count(F.lit(1)).alias("left_in_staging")).withColumn("staged", F.lit(staged).cast("bigint"))


@C.add("A15_bulk_load", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "bulk")
    rows = A.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    files.write_table(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@C.add("A18_upsert", """
    SELECT c_custkey AS athlete_id, coalesce(o.total, c_acctbal) AS value
    FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS total FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey""")
def _(spark, sf):
    base = A.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("athlete_id"), F.col("c_acctbal").alias("value"), F.lit(-1).cast("bigint").alias("version")
    )
    updates = A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("athlete_id"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("version")
    )
    return dedupe.upsert(base, updates, ["athlete_id"], "version").drop("version")


@C.add("A19_missing_table_is_empty", "SELECT c_custkey, count(o_orderkey) AS n_known, 0::BIGINT AS n_missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, sf):
    """Customers with their rows in a table that is there and in one that is not."""
    orders = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("athlete_code"), F.lit("known").alias("kind"))
    missing = files.table_or_empty(spark, "no_such_workout_plans", WORKOUT_PLANS)
    both = orders.unionByName(missing.select(F.col("athlete_code").cast("bigint"), F.lit("missing").alias("kind")))
    counts = both.groupBy("athlete_code").agg(F.count_if(F.col("kind") == "known").alias("k"), F.count_if(F.col("kind") == "missing").alias("m"))
    customers = A.table(spark, sf, "customer").select("c_custkey")
    joined = customers.join(counts, F.col("c_custkey") == F.col("athlete_code"), "left")
    return joined.select("c_custkey", F.coalesce("k", F.lit(0)).alias("n_known"), F.coalesce("m", F.lit(0)).alias("n_missing"))


@C.add("A20_sparse_update", with_views("""
    SELECT athlete_id, CASE WHEN athlete_id % 2 = 0 THEN 'Nuovo' ELSE nome END AS nome,
           CASE WHEN athlete_id % 6 = 0 THEN 'Cognome' ELSE cognome END AS cognome,
           CASE WHEN athlete_id % 2 = 0 THEN '2024-01-01 00:00:00' END AS updated_at
    FROM athletes""", "athletes"))
def _(spark, sf):
    base = A.athletes(spark, sf)
    changes = base.filter("athlete_id % 2 = 0").select(
        "athlete_id", F.lit("Nuovo").alias("nome"), F.when(F.col("athlete_id") % 6 == 0, "Cognome").alias("cognome")
    )
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    done = dedupe.sparse_update(base, changes, "athlete_id", ["nome", "cognome"], stamp)
    return done.withColumn("updated_at", A.second(F.col("updated_at")))


@C.add("C11_repeated_load_adds_nothing", """
    SELECT CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS ym, 0::BIGINT AS new_rows, count(*) AS present FROM orders GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "idempotent")
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    files.write_table(orders, path)
    loaded = spark.read.schema(orders.schema).parquet(path)
    files.write_table(joins.new_rows_only(orders, loaded, "o_orderkey"), path)
    back = spark.read.schema(orders.schema).parquet(path)
    repeated = back.groupBy("o_orderkey", "o_orderdate").agg((F.count(F.lit(1)) - 1).alias("extra"))
    return repeated.groupBy(month_number(F.col("o_orderdate")).alias("ym")).agg(
        F.sum("extra").alias("new_rows"), F.count(F.lit(1)).alias("present")
    )
