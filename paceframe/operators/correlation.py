"""Correlation tables and matrices in long form."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe.functions.numbers import safe_corr


def correlation_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson matrix as rows ``(keys, x, y, r, n)``, from one aggregation pass.

    Rows with a NULL in any column are dropped first. Without keys an empty input gives an
    empty result. ``r`` is NULL where a column is constant and 1 on the diagonal.
    """
    complete = df.na.drop(subset=list(columns))
    pairs = list(combinations(columns, 2))
    exprs = [safe_corr(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    stats = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *exprs).filter(F.col("n") > 0)
    cells = [F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("r")) for c in columns]
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r")))
    return stats.select(*keys, "n", F.inline(F.array(*cells))).select(*keys, "x", "y", "r", "n")


def correlation_vector(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same matrix through ``VectorAssembler`` and ``ml.stat.Correlation``.

    Starts a job: the statistic is eager in Spark ML. Only the matrix, whose size is the
    square of the number of columns, comes to the driver. Empty input gives an empty result.
    """
    spark = df.sparkSession
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    schema = "x string, y string, r double"
    if numeric.isEmpty():
        return spark.createDataFrame([], schema)
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(numeric)
    values = Correlation.corr(vectors, "features", "pearson").head()[0].toArray()
    rows = [(a, b, float(values[i][j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return spark.createDataFrame(rows, schema)


# Row labels and columns of the dashboard correlation table.
DASHBOARD_METRICS = {
    "HRV": "hrv",
    "Readiness": "readiness",
    "Injury Risk": "injury_risk_pct",
    "ACWR": "acwr",
    "TRIMP 7d": "trimp_7d",
}
DASHBOARD_COLUMNS = {
    "volume": "trimp_7d",
    "acwr": "acwr",
    "wellness": "injury_risk_pct",
    "readiness": "readiness",
}


def dashboard_correlations(status: DataFrame) -> DataFrame:
    """Five metrics against four columns in one pass; undefined is 0, a metric with itself 1."""

    def cell(metric: str, column: str) -> Column:
        if metric == column:
            return F.lit(1.0)
        r = F.col(f"_{'__'.join(sorted((metric, column)))}")
        return F.when(F.isnan(r), 0.0).otherwise(F.coalesce(r, F.lit(0.0)))

    wanted = {tuple(sorted((m, c))) for m in DASHBOARD_METRICS.values() for c in DASHBOARD_COLUMNS.values() if m != c}
    stats = status.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"_{a}__{b}") for a, b in sorted(wanted)])
    rows = [
        F.struct(
            F.lit(label).alias("metric"),
            *[cell(metric, column).alias(name) for name, column in DASHBOARD_COLUMNS.items()],
        )
        for label, metric in DASHBOARD_METRICS.items()
    ]
    return stats.select(F.inline(F.array(*rows)))
