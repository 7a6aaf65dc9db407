"""Splitting of hot groups, so that no task ever owns an unbounded group.

Session windows are cheap when sessions are small: one exchange and one sort. A single
session may still hold a large share of all rows. ``over_sessions`` therefore computes the
size of every group from the key columns alone, keeps small groups on the plain path and
cuts each hot group into pieces of equal row count. A piece starts with a halo, the few
rows before it that a trailing frame needs, so every result is the same as without the cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceframe.config import HotGroups
from paceframe.runtime import written

SLOT = 4096
#: Slot of the rows without an axis value: before all others, as in an ordered window.
NULL_SLOT = -(1 << 52)


def group_key(keys: Sequence[str]) -> Column:
    """The keys as one struct; unlike the columns themselves it is never NULL, and NULL parts are equal."""
    return F.struct(*keys)


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """Keys of the groups with more than ``max_rows`` rows (a pruned scan and a partial count)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows).select(*keys)


def split_hot(df: DataFrame, keys: Sequence[str], max_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary groups, rows of hot groups).

    The broadcast is bounded: at most ``rows / max_rows`` keys can be hot. With none, AQE
    sees the empty broadcast and drops the hot branch. NULL keys form groups like any other.
    """
    hot = F.broadcast(hot_keys(df, keys, max_rows).select(group_key(keys).alias("_g")))
    keyed = df.withColumn("_g", group_key(keys))
    return keyed.join(hot, "_g", "left_anti").drop("_g"), keyed.join(hot, "_g", "left_semi").drop("_g")


def running_count(
    df: DataFrame, keys: Sequence[str], axis: str, measure: str | Column | None = None, levels: int = 3
) -> DataFrame:
    """Per (keys, axis value): ``n`` rows there and ``before`` rows at smaller axis values.

    A running total over an integer axis without a window over the whole group: the axis is
    cut into slots of 4096 values, slots into blocks of 4096 slots and so on, totals are
    summed per level and each window sees at most 4096 rows. Only the topmost level has one
    window per group, with one row per 4096**(levels - 1) axis values. Keys and axis must
    not be NULL; :func:`group_key` makes one such key of any columns.
    """
    weight = F.lit(1) if measure is None else (F.col(measure) if isinstance(measure, str) else measure)
    keys = list(keys)
    base = df.groupBy(*keys, axis).agg(F.sum(weight).cast("bigint").alias("n"))
    coarse = [f"_level{i}" for i in range(1, levels)]
    for i, name in enumerate(coarse, start=1):
        base = base.withColumn(name, F.floor(F.col(axis) / F.lit(SLOT**i)).cast("bigint"))
    path = [*reversed(coarse), axis]
    result = base
    offsets = F.lit(0).cast("bigint")
    for depth, level in enumerate(path):
        parents = [*keys, *path[:depth]]
        window = Window.partitionBy(*parents).orderBy(level) if parents else Window.orderBy(level)
        before = F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if level == axis:
            result = result.withColumn("_within", before)
        else:
            here = base.groupBy(*parents, level).agg(F.sum("n").alias("n"))
            totals = here.withColumn(f"_before{depth}", before).drop("n")
            result = result.join(totals, [*parents, level])
            offsets = offsets + F.col(f"_before{depth}")
    return result.withColumn("before", offsets + F.col("_within")).select(*keys, axis, "n", "before")


def dense_position(df: DataFrame, keys: Sequence[str], axis: str, name: str = "_pos") -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by the integer ``axis``.

    ``axis`` must be unique within a group, so a slot holds at most 4096 rows and the window
    below is bounded whatever the size of the group. Rows without an axis value come first;
    NULL keys are a group like any other. No row is lost.
    """
    slot = F.coalesce(F.floor(F.col(axis) / F.lit(SLOT)).cast("bigint"), F.lit(NULL_SLOT))
    slotted = df.withColumn("_g", group_key(keys)).withColumn("_slot", slot)
    starts = running_count(slotted.select("_g", "_slot"), ["_g"], "_slot", levels=2)
    starts = starts.select("_g", "_slot", F.col("before").alias("_start"))
    in_slot = Window.partitionBy("_g", "_slot").orderBy(axis)
    numbered = slotted.withColumn("_rn", F.row_number().over(in_slot))
    placed = numbered.join(starts, ["_g", "_slot"])
    return placed.withColumn(name, F.col("_start") + F.col("_rn") - 1).drop("_g", "_slot", "_rn", "_start")


def value_counts_before(df: DataFrame, column: str) -> DataFrame:
    """Per different value of ``column``: ``n`` rows with it and ``before`` rows with smaller ones; NULL is left out.

    Values are compared as they are. The counts are dealt by range of the value and written
    once; each range is numbered by itself and shifted by the totals of the ranges before it,
    one number per partition on the driver. Starts jobs.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = written(counts.repartitionByRange("value").withColumn("_part", F.spark_partition_id()), "value-counts")
    totals = sorted(ranged.groupBy("_part").agg(F.sum("n")).collect())
    starts = [(part, sum(n for _, n in totals[:at])) for at, (part, _) in enumerate(totals)]
    shifts = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    earlier = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("_within", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return within.join(shifts, "_part").select("value", "n", (F.col("_start") + F.col("_within")).alias("before"))


def chunk_with_halo(df: DataFrame, chunk_rows: int, halo: int, pos: str = "_pos") -> DataFrame:
    """Cut by position into ``_chunk``; the last ``halo`` rows are repeated, flagged ``_halo``, in the next one."""
    size = max(chunk_rows, halo, 1)
    home = F.floor(F.col(pos) / F.lit(size)).cast("bigint")
    at_end = F.pmod(F.col(pos), F.lit(size)) >= F.lit(size - halo)
    targets = F.when(at_end, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_chunk", F.explode(targets))
    return spread.withColumn("_halo", F.col("_chunk") != home)


def over_sessions(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    halo: int,
    build: Callable[[DataFrame, list[str]], DataFrame],
    hot: HotGroups,
    prepare: Callable[[DataFrame], DataFrame] = lambda frame: frame,
) -> DataFrame:
    """Apply trailing-window logic per group, whatever the group sizes.

    ``build(frame, partition_columns)`` adds window columns that look back at most ``halo``
    rows along ``axis``. ``prepare`` runs first on either branch and must leave ``axis``
    unique within a group; on the hot branch it runs before the cut, so it has to combine
    before its shuffle (a top-1 per key does).
    """
    keys = list(keys)
    ordinary, big = split_hot(df, keys, hot.max_rows)
    plain = build(prepare(ordinary.repartition(*keys)), keys)
    cut = chunk_with_halo(dense_position(prepare(big), keys, axis), hot.chunk_rows, halo)
    pieces = build(cut, [*keys, "_chunk"]).filter(~F.col("_halo"))
    return plain.unionByName(pieces.select(*plain.columns))
