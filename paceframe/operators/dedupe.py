"""One row per key, chosen by a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in ``order``.

    The remaining columns complete the order, so the result does not depend on the shuffle.
    ``row_number() = 1`` is planned with a group limit before the exchange: each map task
    sends at most one row per key, so a key with very many copies does not pile up.
    """
    rest = [F.col(c) for c in df.columns if c not in keys]
    window = Window.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The newest row of each key; NULL times count as oldest."""
    rest = [c for c in df.columns if c not in keys and c not in newest]
    order = [F.col(c).desc_nulls_last() for c in [*newest, *rest]]
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """Rows of ``base`` replaced or extended by ``updates``: the new value wins.

    With ``version`` the newest update of a key is taken first, so a batch may hold several.
    """
    newest = latest_per_key(updates, keys, [version]) if version else updates
    tagged = base.withColumn("_new", F.lit(0)).unionByName(newest.withColumn("_new", F.lit(1)))
    return latest_per_key(tagged, keys, ["_new"]).drop("_new")


def sparse_update(
    base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], stamp: Column | None = None
) -> DataFrame:
    """Change only the supplied (non-NULL) fields and stamp ``updated_at`` on changed rows."""
    marked = changes.select(key, *[F.col(c).alias(f"_u_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = base.join(marked, key, "left")
    keep = [F.col(c) for c in base.columns if c not in columns and c != "updated_at"]
    previous = F.col("updated_at") if "updated_at" in base.columns else F.lit(None).cast("timestamp")
    when = F.current_timestamp() if stamp is None else stamp
    return joined.select(
        *keep,
        *[F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) for c in columns],
        F.when(F.col("_hit"), when).otherwise(previous).alias("updated_at"),
    )
