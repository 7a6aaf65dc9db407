"""A left join with a table of one row per key that no hot key can hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more than 1 / HOT of all uses are hot, so there are fewer than HOT of them.
HOT = 4096


def join_unique(left: DataFrame, right: DataFrame, on: str, uses: str, spread: Column) -> DataFrame:
    """``left`` with the columns of ``right`` joined on ``on``, a string column of both; left rows without a partner stay.

    ``right`` has one row per key, and in ``uses`` how many left rows have it. Rows of hot keys, fewer than ``HOT``, are
    broadcast and their left rows dealt by ``spread``; the rest are shuffled by the key, where none has more than 1 / ``HOT``
    of the rows. Rows of ``right`` should be cheap to read twice, such as a written table. Starts a job.
    """
    values = [c for c in right.columns if c not in (on, uses)]
    total = right.agg(F.sum(uses)).first()[0] or 0
    many = F.col(uses) * HOT > total
    table = right.select(F.col(on).alias("_on"), F.struct(F.lit(True).alias("_is"), *values).alias("_value"), many.alias("_many"))
    hot = table.where("_many").select(F.col("_on").alias("_hot"), F.col("_value").alias("_hot_value"))
    rare = table.where("NOT _many").drop("_many")
    own = F.concat(F.lit("\0"), F.xxhash64(spread).cast("string")).alias("_own")
    held = left.select(F.struct(*left.columns).alias("_left"), F.col(on).alias("_key"), own)
    held = held.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    dealt = held.withColumn("_key", F.when(F.col("_hot").isNull() & F.col("_key").isNotNull(), F.col("_key")).otherwise(F.col("_own")))
    joined = dealt.join(rare, F.col("_key") == F.col("_on"), "left").withColumn("_value", F.coalesce("_hot_value", "_value"))
    return joined.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[F.col("_value")[c].alias(c) for c in values])
