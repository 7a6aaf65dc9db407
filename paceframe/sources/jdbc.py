"""JDBC tables: partitioned reads, incremental scans and batched appends.

The driver jar of the database must be on the class path; nothing here opens a connection
until Spark does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Database:
    """Where a database is and how to log in."""

    url: str
    user: str | None = None
    password: str | None = None
    driver: str | None = None
    fetch_size: int = 10_000
    batch_size: int = 50_000
    extra: dict[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        """Options common to reading and writing."""
        given = {"url": self.url, "user": self.user, "password": self.password, "driver": self.driver}
        return {**{k: v for k, v in given.items() if v}, **self.extra}


@dataclass(frozen=True)
class Split:
    """A numeric, date or timestamp column and its range, cut into ``partitions`` reads."""

    column: str
    lower: str
    upper: str
    partitions: int


def read_options(db: Database, table: str, split: Split | None = None) -> dict[str, str]:
    """Reader options; with a split the table is read by many tasks instead of one."""
    options = {**db.options(), "dbtable": table, "fetchsize": str(db.fetch_size)}
    if split:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": str(split.lower),
            "upperBound": str(split.upper),
            "numPartitions": str(split.partitions),
        }
    return options


def read_table(spark: SparkSession, db: Database, table: str, split: Split | None = None) -> DataFrame:
    """A table; filters and column pruning are pushed to the database."""
    return spark.read.format("jdbc").options(**read_options(db, table, split)).load()


def incremental_scan(source: DataFrame, key: str, high_water_mark: DataFrame | int) -> DataFrame:
    """Rows beyond the high-water mark; one partitioned read replaces paging.

    A number is pushed into the scan. A one-row frame becomes a scalar subquery.
    """
    mark = F.lit(high_water_mark) if isinstance(high_water_mark, int) else high_water_mark.scalar()
    return source.filter(F.col(key) > mark)


def appender(df: DataFrame, db: Database, table: str) -> DataFrameWriter:
    """An append writer with batched inserts; call ``save()`` on it."""
    options = {**db.options(), "dbtable": table, "batchsize": str(db.batch_size)}
    return df.write.format("jdbc").options(**options).mode("append")


def append_batch(db: Database, table: str, key: list[str]):
    """A ``foreachBatch`` function that appends each micro-batch once.

    Rows carry ``batch_id``; on a replay, keys already stored for that batch are left out,
    which makes the at-least-once callback idempotent.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        stored = read_table(batch.sparkSession, db, table).filter(F.col("batch_id") == batch_id)
        fresh = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).join(
            stored.select(*key), key, "left_anti"
        )
        appender(fresh, db, table).save()

    return write
