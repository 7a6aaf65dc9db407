"""Population ranks without a window over the population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe.functions.numbers import ratio
from paceframe.operators.skew import value_counts_before


def population_rank(df: DataFrame, column: str, buckets: int = 100) -> DataFrame:
    """Add percent rank, percentile bucket and z-score of ``column`` among all rows.

    ``percent_rank`` is (rows below) / (rows - 1) as the window function defines it. Counts
    per range of the value replace the unpartitioned window; equal values share a rank. The
    z-score uses the population deviation. Starts jobs.
    """
    below = value_counts_before(df, column)
    stats = df.agg(
        F.struct(
            F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd")
        ).alias("s")
    ).scalar()
    joined = df.join(below.select(F.col("value").alias(column), "before"), column, "left").withColumn("_s", stats)
    percent: Column = F.coalesce(
        ratio(F.col("before"), F.col("_s.n") - 1), F.when(F.col("before").isNotNull(), F.lit(0.0))
    )
    return joined.select(
        *df.columns,
        percent.alias("percent_rank"),
        F.when(percent.isNotNull(), F.least(F.lit(buckets), F.floor(percent * buckets) + 1)).cast("int").alias("percentile"),
        ratio(F.col(column) - F.col("_s.mean"), F.col("_s.sd")).alias("z_score"),
    )
