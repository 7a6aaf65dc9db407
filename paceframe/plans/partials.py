"""Roll-ups kept up to date day by day: partial aggregates in month partitions, replaced only where days changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.functions.dates import month_number
from paceframe.runtime import written

#: How partial aggregates of each kind are made from rows, and merged.
MAKE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class DailyPartials:
    """A table of one row per key and day below ``path``, partitioned by month (``ym``).

    ``measures`` maps an output column to its kind and source column. Means and rates are quotients of merged sums and counts.
    Days are dates; rows without one are in the month and day NULL, which is corrected like any other.
    """

    path: str
    keys: Sequence[str]
    day: str
    measures: Mapping[str, tuple[str, str]]

    def of(self, facts: DataFrame) -> DataFrame:
        """The partial aggregates of fact rows: one shuffle of narrow rows, combined before it."""
        day = F.to_date(self.day)
        made = [MAKE[kind](column).alias(name) for name, (kind, column) in self.measures.items()]
        return facts.groupBy(*self.keys, day.alias("day")).agg(*made).withColumn("ym", month_number(F.col("day")))

    def build(self, facts: DataFrame) -> None:
        """Write all months anew."""
        self._write(self.of(facts), "static")

    def refresh(self, facts: DataFrame, days: DataFrame) -> None:
        """Take the days (column ``day``) from ``facts`` again, as they are now; a day that lost its rows loses its partials.

        The facts of other days are not aggregated, and files of other months not touched. A month that loses all its rows
        keeps an empty file. There are few calendar days and months, so both go to every task. Starts jobs.
        """
        spark = facts.sparkSession
        days = written(days.select(F.to_date("day").alias("day")).distinct(), "changed-days")
        months = days.select(month_number(F.col("day")).alias("ym")).distinct()
        same_day, same_month = _same("day"), _same("ym")
        fresh = self.of(facts.withColumn("_day", F.to_date(self.day)).alias("l").join(F.broadcast(days.alias("r")), F.col("l._day").eqNullSafe(F.col("r.day")), "left_semi"))
        own = self.read(spark).alias("l").join(F.broadcast(months.alias("r")), same_month, "left_semi")
        kept = own.alias("l").join(F.broadcast(days.alias("r")), same_day, "left_anti")
        # written first: the months that are read are the ones that are replaced
        merged = written(kept.select(*fresh.columns).unionByName(fresh), "refreshed-months")
        gone = [r["ym"] for r in months.join(merged.select("ym").distinct().alias("m"), months["ym"].eqNullSafe(F.col("m.ym")), "left_anti").collect()]
        self._write(merged, "dynamic")
        for month in gone:  # dynamic overwrite leaves partitions without rows as they were
            part = "__HIVE_DEFAULT_PARTITION__" if month is None else month
            spark.createDataFrame([], fresh.drop("ym").schema).write.mode("overwrite").parquet(f"{self.path}/ym={part}")

    def _write(self, partials: DataFrame, mode: str) -> None:
        rows = partials.hint("rebalance", F.col("ym")).sortWithinPartitions("ym", *self.keys, "day")
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("ym").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def merged(self, spark: SparkSession, *by: str | Column) -> DataFrame:
        """The measures over any grouping of keys and columns of the day; filters on ``ym`` may be put on :meth:`read` instead."""
        return self.merge(self.read(spark), *by)

    def merge(self, partials: DataFrame, *by: str | Column) -> DataFrame:
        return partials.groupBy(*by).agg(*[MERGE[kind](name).alias(name) for name, (kind, _) in self.measures.items()])


def _same(column: str) -> Column:
    return F.col(f"l.{column}").eqNullSafe(F.col(f"r.{column}"))
