"""Compare every registered query with its SQL on the same tables.

    python tests/oracle.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and the SQL's rows; empty when they agree."""
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    expected = _rows(sql_columns, result.fetchall())
    actual = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(spark_df.columns) != sorted(sql_columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(sql_columns)}"]
    problems = []
    if len(actual) != len(expected):
        problems.append(f"rows {len(actual)} != {len(expected)}")
    mine, theirs = set(actual) - set(expected), set(expected) - set(actual)
    if mine or theirs:
        problems.append(f"only spark ({len(mine)}): {sorted(mine, key=repr)[:2]}; only sql ({len(theirs)}): {sorted(theirs, key=repr)[:2]}")
    if not problems and actual != expected:
        problems.append("same rows in different numbers")
    if actual and expected:
        kinds_a = [type(next((r[i] for r in actual if r[i] is not None), None)) for i in range(len(actual[0]))]
        kinds_e = [type(next((r[i] for r in expected if r[i] is not None), None)) for i in range(len(expected[0]))]
        if kinds_a != kinds_e:
            problems.append(f"types {sorted(spark_df.columns)}: {kinds_a} != {kinds_e}")
    return problems


if __name__ == "__main__":
    import __spark_entry__ as entry
    from paceframe.runtime import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark__sql__shuffle__partitions": "8", "spark__driver__memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf), entry.oracle_sql()
    failed = []
    for name, query in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        began = time.time()
        try:
            df = query(spark, sf)
            found = differences(df, con, sql[name]) if name in sql else [] if df.count() >= 0 else ["no rows"]
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
        print(f"{'ok  ' if not found else 'FAIL'} {name} {time.time() - began:.1f}s {'' if name in sql else '(no sql)'}", flush=True)
        for f in found:
            print("     ", f[:1500], flush=True)
        if found:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
