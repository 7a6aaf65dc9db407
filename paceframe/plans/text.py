"""Word count over text files or any text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.operators.rollups import word_counts


def word_count_report(texts: DataFrame, column: str = "value") -> DataFrame:
    """Words by falling count, then alphabetically."""
    return word_counts(texts, column).orderBy(F.col("count").desc(), F.col("word").asc())
