"""Text, JSON-lines and Parquet tables in shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.functions.dates import month_number


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files in column ``value``."""
    return spark.read.text(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def write_monthly(df: DataFrame, path: str, ts: str, sort: Sequence[str], mode: str = "append") -> None:
    """A table partitioned by month and sorted by key inside each file.

    Rows are rebalanced by month at run time: AQE splits a month that holds most of the rows
    over several tasks and merges small months, so neither one huge task nor a flood of
    small files results.
    """
    staged = df.withColumn("ym", month_number(F.col(ts))).hint("rebalance", F.col("ym"))
    staged.sortWithinPartitions("ym", *sort).write.mode(mode).partitionBy("ym").parquet(path)


def distribute(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Hash distribution by a key, the layout of the sharded table."""
    return df.repartition(parts, key)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, sort: Sequence[str] = ()) -> None:
    """A bucketed table: later joins and groupings on the key need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(*(sort or (key,))).saveAsTable(table)


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Bulk load as Parquet."""
    df.write.mode(mode).parquet(path)


def truncate(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Empty a staging table, keeping its schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A catalog table, or an empty frame of the schema when it does not exist."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def require_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table that must exist."""
    if not spark.catalog.tableExists(name):
        raise LookupError(f"required table is missing: {name}")
    return spark.table(name)
