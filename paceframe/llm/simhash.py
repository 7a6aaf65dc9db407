"""SimHash near-duplicates by exact tiled comparison; tiles are cells of population counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.llm.batches import blobs, fields, folded, map_batches, parts
from paceframe.llm.components import components, forest
from paceframe.runtime import written

#: Quarters of a fingerprint and the values that a quarter's population count can take.
QUARTERS, LEVELS = 4, 17
#: Fingerprints in a tile; tiles of one cell that a task takes as its left side; numbers compared at once.
TILE, BAND, BLOCK = 4096, 16, 1 << 21
#: Words hashed at once.
RUN = 1 << 16


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles as unsigned numbers, repeats included, in runs.

    A-Z are lower-cased; words are runs of anything but space and tab to carriage return; shingles are
    ``words`` words joined by spaces. Fewer words are one shingle; none give no run.
    """
    found = text.lower().split()
    one = xxhash.xxh64_intdigest
    for first in range(0, max(1, len(found) - words + 1) if found else 0, RUN):
        some = found[first : first + RUN + words - 1]
        flat = b" ".join(some)
        ends = list(accumulate([len(w) + 1 for w in some]))
        yield np.array([one(flat[a : b - 1], seed) for a, b in zip([0, *ends], ends[min(words, len(ends)) - 1 :], strict=False)], "<u8")


def majority(runs: Iterable[np.ndarray]) -> int:
    """64 bits as an unsigned number: a bit is 1 if more than half of all hashes have it; without hashes 0."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in runs:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """A text's fingerprint, the :func:`majority` of its :func:`shingle_hashes`; 0 without words."""
    return majority(shingle_hashes(text, words, seed))


def _fingerprints(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text", 1 << 23):
                found = np.array([fingerprint(x, words) for x in blobs(part, "_text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_row"), pa.array(found)], names=["_id", "_row", "fp"])

    return work


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(_id, _row, fp): the key, a hash of the row, and the fingerprint as a signed number. NULL text: no words, 0."""
    narrow = df.select(F.col(key).alias("_id"), F.xxhash64(key, text).alias("_row"), F.col(text).cast("binary").alias("_text"))
    return map_batches(narrow, _fingerprints(words), [*fields(narrow, _id="_id", _row="_row"), T.StructField("fp", T.LongType())])


def _compare(radius: int):
    def near(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, BLOCK // max(1, len(left)))
        for at in range(0, len(right), step):
            some = right[at : at + step]
            # NumPy counts the bits of a signed number's absolute value.
            i, j = np.nonzero(np.bitwise_count((left[:, None] ^ some[None, :]).view(np.uint64)) <= radius)
            apart = left[i] != some[j]
            if apart.any():
                yield left[i[apart]], some[j[apart]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            names = batch.column("place").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)] if len(names) else []
            left, right = batch.column("fps"), batch.column("others")
            for a, b in zip(cuts, cuts[1:], strict=False):
                one = left.slice(a, 1).flatten().to_numpy(zero_copy_only=False)
                for pair in near(one, right.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)):
                    kept.append(forest(*pair))
                    held += len(kept[-1][0])
            if held > BLOCK:
                kept = [forest(*(np.concatenate(x) for x in zip(*kept, strict=True)))]
                if len(kept[0][0]) > BLOCK // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, kept.pop())), names=["a", "b"])
                held = sum(len(x) for x, _ in kept)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*(np.concatenate(x) for x in zip(*kept, strict=True)))], names=["a", "b"])

    return work


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links that join all different fingerprints of the column ``fp`` within ``radius`` bits into groups.

    Cells are the population counts of a fingerprint's four quarters. Two fingerprints within the radius lie in
    cells whose counts differ by no more in sum, so other cells' tiles are never met. A cell's fingerprints are
    dealt over tiles by hash; a task compares up to ``BAND`` tiles of a cell with the tiles of the cells around
    it, all pairs exactly, and gives a spanning forest of what it found instead of all links. The table of cells
    has at most 17 ** 4 rows, so it may be broadcast.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(QUARTERS)]
    levels = [LEVELS**i for i in range(QUARTERS)]
    cell = sum((q * n for q, n in zip(quarter[1:], levels[1:], strict=True)), quarter[0])
    different = fps.select("fp").distinct().withColumn("cell", cell.cast("int"))
    cells = written(different.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "cells")
    few = F.broadcast(cells)
    tiles = different.join(few, "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), "tiles").cast("int").alias("tile")).agg(F.collect_list("fp").alias("fps"))
    tiles = written(tiles, "tiles")

    # Half of the cells around a cell, and the cell itself: each pair of cells meets once.
    steps = [s for s in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, s)) <= radius and s >= (0,) * QUARTERS]
    around = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(s)], F.lit(sum(d * n for d, n in zip(s, levels, strict=True))).alias("move")) for s in steps])
    inside = F.lit(True)
    for i, n in enumerate(levels):
        at = F.pmod(F.floor(F.col("own") / n), F.lit(LEVELS)) + F.col("step")[f"d{i}"]
        inside = inside & at.between(0, LEVELS - 1)
    moved = tiles.select(F.col("cell").alias("own"), F.col("tile").alias("other"), F.col("fps").alias("others"))
    right = moved.withColumn("step", F.explode(around)).where(inside).withColumn("cell", F.col("own") + F.col("step")["move"]).drop("step")
    bands = F.sequence(F.lit(0), F.floor((F.col("tiles") - 1) / BAND).cast("int"))
    right = right.join(few, "cell").select("cell", "own", "other", "others", F.explode(bands).alias("band"))
    left = tiles.withColumn("band", F.floor(F.col("tile") / BAND).cast("int"))
    pairs = left.join(right, ["cell", "band"]).where("cell != own or other <= tile")
    pairs = pairs.select((F.col("cell").cast("long") * (1 << 31) + F.col("tile")).alias("place"), "fps", "others")
    return map_batches(pairs, _compare(radius), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """Each row's fingerprint and group: key, ``_row`` (a hash of the row), ``fingerprint`` (16 hexadecimal digits),
    ``component_id``, the smallest key that links of ``radius`` bits or fewer reach, and ``root``, the group's smallest
    fingerprint as a signed number.

    NULL and empty texts have fingerprint zero and are linked like any other. Rows with a NULL key take part; the
    smallest key ignores them. Repeated rows give repeated results; an empty table gives no rows; other columns
    are ignored. Starts jobs: fingerprints are written once, links are found among the different ones.
    """
    fps = written(fingerprints(df, key, text, words), "fingerprints")
    groups = components(links(fps, radius))
    least = fps.groupBy("fp").agg(F.min("_id").alias("_least"))
    rooted = least.join(groups, least["fp"] == groups["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select(F.col("_id").alias(key), "_row", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def first_of_groups(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df`` whose key is the smallest (NULL last) of their ``root`` in ``found``; of rows that repeat key and text one."""
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_row").alias("row"))
    chosen = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first")["row"].alias("_row"))
    narrow, back = folded(df, key, text)
    stay = narrow.withColumn("_row", F.xxhash64(key, text)).join(chosen, "_row", "left_semi")
    repeated = found.groupBy("_row").count().where("count > 1").select("_row")
    once = stay.join(repeated, "_row", "left_anti")
    return back(once.unionByName(stay.join(repeated, "_row", "left_semi").dropDuplicates(["_row"])))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each group the row of the smallest key (NULL last) stays.

    All columns are kept, whatever their names. Of rows that repeat key and text one stays. Texts are read whole, whatever their
    length; an empty table stays empty. Starts jobs.
    """
    return first_of_groups(df, near_duplicates(df, key, text, words, radius), key, text)
