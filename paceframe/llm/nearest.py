"""Nearest neighbours by inner product: int8 tiles with error bounds, survivors in double precision, merged tops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceframe.llm.batches import map_batches
from paceframe.runtime import written

#: Vectors of WIDTH components in a block of queries and of candidates, fewer if they are wider; candidate blocks and query blocks that meet in
#: one group.
QUERIES, CANDIDATES, WIDTH, GROUP, ASKED = 512, 2048, 64, 16, 8
#: Components whose products of codes add up to less than 2^24, so that single precision holds the sum exactly.
EXACT = 1024
#: Slack on the error bounds for the rounding of the bounds themselves.
SLACK = 1e-9


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): rows with an id whose vector holds finite numbers only, not all zero; components as doubles."""
    as_double = F.col(vector).cast("array<double>")
    good = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(as_double, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & good).select(F.col(key).cast("long").alias("id"), as_double.alias("vec"))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of -127 to 127 (as float32, for exact products), scales, norms of the coded vectors and of what they miss."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    coded = codes * scale[:, None]
    return codes.astype(np.float32), scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of codes, however wide."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at : at + EXACT] @ b[:, at : at + EXACT].T
    return out


def _size(most: int) -> Column:
    """Vectors of a block, by their width."""
    return F.greatest(F.lit(16), F.least(F.lit(most), F.floor(F.lit(most * WIDTH) / F.col("width")))).cast("int")


def _blocks(rows: DataFrame, most: int, counts: DataFrame) -> DataFrame:
    """Rows (id, vec) dealt by hash into blocks of about as many bytes: width, block, rows. ``counts`` has a row per dimension."""
    sized = rows.withColumn("width", F.size("vec")).join(F.broadcast(counts), "width")
    block = F.pmod(F.xxhash64("id", "vec"), F.ceil(F.col("n") / _size(most))).cast("int")
    return sized.groupBy("width", block.alias("block")).agg(F.collect_list(F.struct("id", "vec")).alias("rows"))


def _numbers(counts: DataFrame, most: int, together: int, name: str) -> DataFrame:
    """(width, name): the groups of ``together`` blocks of each dimension."""
    last = F.ceil(F.ceil(F.col("n") / _size(most)) / together).cast("int") - 1
    return counts.select("width", F.explode(F.sequence(F.lit(0), last)).alias(name))


def _unpacked(column: pa.ListArray, at: int, width: int) -> tuple[list[list[int]], np.ndarray]:
    """Ids and vectors of one block."""
    rows = column.slice(at, 1).flatten()
    return rows.field("id").to_pylist(), rows.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Tops:
    """The best ``k`` candidates of each query of a block so far: score descending, then id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.codes, self.scale, self.coded, self.missed = quantised(vectors)
        self.norm = np.linalg.norm(vectors, axis=1)
        self.bar = np.full(len(ids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def meet(self, ids: list[list[int]], vectors: np.ndarray, ready: tuple) -> None:
        """Compare with a block of different vectors; ``ids`` has the smallest ids of each."""
        codes, scale, coded, missed = ready
        rough = products(self.codes, codes) * self.scale[:, None] * scale[None, :]
        error = self.missed[:, None] * coded[None, :] + self.norm[:, None] * missed[None, :]
        error += SLACK * (np.abs(rough) + error)
        # The k-th best lower bound over k + 1 vectors is no more than the k-th best score, the query's own left out.
        low = rough - error
        bar = self.bar
        if low.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(low, -(self.k + 1), axis=1)[:, -(self.k + 1)])
        q, c = np.nonzero(rough + error >= bar[:, None])
        step = max(1, (1 << 20) // vectors.shape[1])
        exact = np.concatenate([(self.vectors[q[a : a + step]] * vectors[c[a : a + step]]).sum(axis=1) for a in range(0, len(q), step)] or [np.zeros(0)])
        many = np.array([len(x) for x in ids])
        flat, first = np.concatenate([np.array(x, np.int64) for x in ids]), np.cumsum(many) - many
        times = many[c]
        place = np.repeat(first[c], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        q, v, s = np.repeat(q, times), flat[place], np.repeat(exact, times)
        other = v != self.ids[q]
        self.found.append((q[other], v[other], s[other]))
        self._keep()

    def _keep(self) -> None:
        q, v, s = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        start = np.searchsorted(q, np.arange(len(self.ids)))
        rank = np.arange(len(q)) - start[q]
        best = rank < self.k
        self.found = [(q[best], v[best], s[best])]
        last = rank == self.k - 1
        self.bar[q[last]] = s[last]

    def rows(self) -> pa.RecordBatch:
        q, v, s = self.found[0]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])


def _search(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per group, in order: its candidate blocks, then its query blocks."""
        at, ready = None, []
        for batch in batches:
            blocks = batch.column("rows")
            for row, (width, group, asked, kind) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("width", "group", "asked", "kind")), strict=True)):
                if (width, group, asked) != at:
                    at, ready = (width, group, asked), []
                ids, vectors = _unpacked(blocks, row, width)
                if kind == 0:
                    ready.append((ids, vectors, quantised(vectors)))
                elif ready:
                    tops = Tops(np.array([i[0] for i in ids]), vectors, k)
                    for candidates in ready:
                        tops.meet(*candidates)
                    yield tops.rows()

    return work


def nearest(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for each row where ``queries`` is true, its own id left out:
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller id.

    Equal vectors are first made one candidate that carries its ``k + 1`` smallest ids, as no others can be among the
    results; ids are taken to name one vector each. A task holds ``GROUP`` candidate blocks, which ``ASKED`` query blocks of the same
    dimension meet one after the other; blocks are copied once per group, not per pair. Exact int8 products give each
    inner product with an error bound; pairs whose upper bound reaches the k-th best lower bound so far are computed in
    double precision. Each group hands on ``k`` rows per query, and ranks cut them to ``k`` before and after the shuffle.

    Vectors that are NULL, empty, zero, or hold NULL or non-finite components take no part, nor do rows without an id. Rows
    that repeat id and vector are one candidate; repeated query rows are one query. Vectors of different dimensions never
    meet. An empty table gives no rows; other columns are ignored. Starts jobs.
    """
    good = valid(vectors, key, vector)
    same = Window.partitionBy("vec").orderBy("id")
    few = good.distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    candidates = written(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("id")), "candidates")
    asked = valid(vectors.where(queries), key, vector).distinct()
    counts = candidates.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"))
    query_counts = asked.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"))
    group, some = F.floor(F.col("block") / GROUP).cast("int").alias("group"), F.floor(F.col("block") / ASKED).cast("int").alias("asked")
    right = _blocks(candidates, CANDIDATES, counts).select("width", group, F.lit(0).alias("kind"), "block", "rows")
    right = right.join(F.broadcast(_numbers(query_counts, QUERIES, ASKED, "asked")), "width")
    left = _blocks(asked.withColumn("id", F.array("id")), QUERIES, query_counts).select("width", some, F.lit(1).alias("kind"), "block", "rows")
    left = left.join(F.broadcast(_numbers(counts, CANDIDATES, GROUP, "group")), "width")
    order = ["width", "group", "asked", "kind"]
    pairs = right.select(*order, "block", "rows").unionByName(left.select(*order, "block", "rows"))
    pairs = pairs.repartition("width", "group", "asked").sortWithinPartitions(*order, "block").select(*order, "rows")
    found = map_batches(pairs, _search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
