"""Pairwise-complete correlations of many columns by tiles of the Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import batched, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.functions.numbers import ratio
from paceframe.runtime import send_by_value

send_by_value()

#: Columns in a block, and tiles (pairs of blocks) that a task sums at once: 512 tiles hold 100 MB.
BLOCK, TILES = 64, 512
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _tile(x: np.ndarray, y: np.ndarray, in_x: np.ndarray, in_y: np.ndarray) -> np.ndarray:
    """The sums of :data:`SUMS` for each column of ``x`` with each of ``y`` over rows that have both."""
    return np.stack([in_x.T @ in_y, x.T @ in_y, in_x.T @ y, (x * x).T @ in_y, in_x.T @ (y * y), x.T @ y])


def _summed(tiles: Sequence[tuple[int, int]], blocks: Sequence[range], names: Sequence[str], pivots: Sequence[float]):
    """Each task's own sums over its rows; the tables' columns are ``names``, less their pivots."""
    place = {c: i for i, c in enumerate(names)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            rows = np.empty((batch.num_rows, len(names)))
            for i, column in enumerate(batch.columns):
                rows[:, i] = column.to_numpy(zero_copy_only=False)
            there = np.isfinite(rows)
            rows = np.where(there, rows - np.array(pivots), 0.0)
            there = there.astype(np.float64)
            for a, b in tiles:
                left, right = ([place[f"c{k}"] for k in blocks[t]] for t in (a, b))
                part = _tile(rows[:, left], rows[:, right], there[:, left], there[:, right])
                sums[a, b] = sums[a, b] + part if (a, b) in sums else part
        for (a, b), part in sums.items():
            i, j = np.meshgrid(blocks[a], blocks[b], indexing="ij")
            upper = i <= j
            yield pa.RecordBatch.from_arrays([pa.array(i[upper], pa.int32()), pa.array(j[upper], pa.int32()), *[pa.array(s[upper]) for s in part]], names=["i", "j", *SUMS])

    return work


def wide_correlation(df: DataFrame, columns: Sequence[str], block: int = BLOCK, tiles: int = TILES) -> DataFrame:
    """Pearson correlation of every pair of ``columns`` as rows ``(x, y, r, n)``, ``x`` not after ``y`` in their order.

    ``n`` counts the rows in which both have a value; only those enter ``r``. NULL, NaN and infinities are no values.
    ``r`` is NULL where a column's values in those rows are all the same (a deviation under a millionth of their distance from
    the column's mean counts as none). An empty table gives no rows; repeated rows count each.

    Unlike one aggregate expression per pair, whose plan and buffers grow with the square of the columns, blocks of columns are
    multiplied in NumPy, task by task, and only the tasks' sums are shuffled, combined before. A pass over the table takes
    at most ``tiles`` pairs of blocks (2000 columns by default), so a task's memory is bounded for any number of columns; it reads only the columns
    of its blocks. Starts a job for the columns' means, around which the sums are taken to keep their digits.
    """
    names = [f"c{k}" for k in range(len(columns))]
    numeric = df.select(*[F.col("`" + c.replace("`", "``") + "`").cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    means = numeric.agg(*[F.avg(F.when(F.abs(n) < float("inf"), F.col(n))).alias(n) for n in names]).first()
    blocks = [range(at, min(at + block, len(names))) for at in range(0, len(names), block)]
    out = None
    for some in batched(combinations_with_replacement(range(len(blocks)), 2), tiles):
        own = [names[k] for t in sorted({t for pair in some for t in pair}) for k in blocks[t]]
        work = _summed(some, blocks, own, [means[n] or 0.0 for n in own])
        part = numeric.select(*own).mapInArrow(work, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
        out = part if out is None else out.unionByName(part)
    total = out.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
    spread = {s: F.col("n") * F.col(f"s{s}{s}") - F.col(f"s{s}") * F.col(f"s{s}") for s in "xy"}
    varied = [spread[s] > 1e-12 * F.col("n") * F.col(f"s{s}{s}") for s in "xy"]
    r = ratio(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(spread["x"]) * F.sqrt(spread["y"]))
    label = F.lit(list(columns))
    return total.select(
        label[F.col("i")].alias("x"),
        label[F.col("j")].alias("y"),
        F.when(varied[0] & varied[1], F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
        F.col("n").cast("long").alias("n"),
    )
