"""Near copies by SimHash fingerprints and by the Jaccard similarity of their shingles.

Fingerprints within the radius are links, as in :mod:`paceframe.llm.simhash`. The narrow radius overlooks most copies of similarity 0.8, so
pairs that share a MinHash band are linked as well if the shingles themselves are similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.llm.batches import blobs, fields, map_batches, parts
from paceframe.llm.components import components, forest
from paceframe.llm.simhash import first_of_groups, majority, shingle_hashes
from paceframe.llm.simhash import links as alike
from paceframe.runtime import written

#: Bands and minima in a band. Two texts of similarity s share no band with probability (1 - s ** 4) ** 28: 4e-7 at 0.8.
BANDS, MINIMA = 28, 4
#: The upper half of ``FACTORS * x + ADDENDS`` modulo 2 ** 64 is a strongly universal hash of the 32-bit number x, one for each minimum.
FACTORS, ADDENDS = np.random.default_rng(20240607).integers(0, 1 << 64, (2, BANDS * MINIMA), dtype=np.uint64)
#: Texts and shingles in a tile, about; links kept by a task; shingles compared, and hashed for the bands, at once.
TILE, TILE_SHINGLES, HELD, RUN, HASHED = 256, 1 << 18, 1 << 20, 4096, 512


def different(runs: list[np.ndarray]) -> np.ndarray:
    """The different hashes in order."""
    return np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """The different shingles' XXH64 in order. Words and shingles are those of :func:`simhash.shingle_hashes`."""
    return different(list(shingle_hashes(text, words, seed)))


def node(own: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def bands(own: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of a set's minima; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = own & np.uint64(0xFFFFFFFF)
    least = np.full(len(FACTORS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(low), HASHED):
        np.minimum(least, (FACTORS[:, None] * low[None, at : at + HASHED] + ADDENDS[:, None]).min(axis=1), out=least)
    least = (least >> np.uint64(32)).astype(np.uint32)
    rows = least.reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64)


def _signed(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text", 1 << 23):
                marks, keys = [], []
                for text in blobs(part, "_text"):
                    runs = list(shingle_hashes(text, words))
                    own = different(runs)
                    marks.append((node(own), len(own), int(np.uint64(majority(runs)).view(np.int64))))
                    keys.append(bands(own))
                offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                columns = [part.column("_id"), part.column("_row"), *[pa.array(x, pa.int64()) for x in zip(*marks, strict=True)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, np.concatenate(keys))], names=["_id", "_row", "node", "n", "fp", "bands"])

    return work


def _sets(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text", 1 << 22):
                sets = [shingles(x, words).view(np.int64) for x in blobs(part, "_text")]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(offsets, np.concatenate(sets))], names=["node", "own"])

    return work


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left shares with each on the right."""
    both = np.zeros((len(left), len(right)), np.int64)
    one, two = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(one, two)
    if len(left) == len(right) == 1:
        return both + len(shared)
    sides = []
    for flat, sets in ((one, left), (two, right)):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        place = np.searchsorted(shared, flat)
        hit = shared[np.minimum(place, len(shared) - 1)] == flat if len(shared) else np.zeros(len(flat), bool)
        place, owner = place[hit], owner[hit]
        order = np.argsort(place, kind="stable")
        sides.append((place[order], owner[order], len(sets)))
    for at in range(0, len(shared), RUN):
        width = min(RUN, len(shared) - at)
        marks = []
        for place, owner, n in sides:
            a, b = np.searchsorted(place, [at, at + width])
            marks.append(np.zeros((n, width), np.float32))
            marks[-1][owner[a:b], place[a:b] - at] = 1
        both += (marks[0] @ marks[1].T).astype(np.int64)
    return both


def _compare(ratio: float):
    def lists(column: pa.Array, row: int) -> list[np.ndarray]:
        inner = column.slice(row, 1).flatten()
        offsets = inner.offsets.to_numpy()
        flat = inner.values.to_numpy(zero_copy_only=False)
        return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]

    def near(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
        nodes, others = (batch.column(c).slice(row, 1).flatten().to_numpy(zero_copy_only=False) for c in ("nodes", "others"))
        left, right = lists(batch.column("sets"), row), lists(batch.column("other_sets"), row)
        if len(nodes) == len(others) == 2 and (nodes == others).all():
            # the usual bucket: one pair
            nodes, others, left, right = nodes[:1], others[1:], left[:1], right[1:]
        both = common(left, right)
        union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - both
        i, j = np.nonzero(both >= ratio * union - 1e-9)
        apart = nodes[i] != others[j]
        return nodes[i[apart]], others[j[apart]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return forest(*(np.concatenate(x) for x in zip(*kept, strict=True)))

        for batch in batches:
            for row in range(batch.num_rows):
                a, b = near(batch, row)
                if len(a):
                    kept.append(forest(a, b))
                    held += len(kept[-1][0])
            if held > HELD:
                kept = [joined()]
                if len(kept[0][0]) > HELD // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, kept.pop())), names=["a", "b"])
                held = sum(len(x) for x, _ in kept)
        if kept:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, joined())), names=["a", "b"])

    return work


def links(signed: DataFrame, narrow: DataFrame, words: int, ratio: float) -> DataFrame:
    """(a, b): links that join all different sets of similarity ``ratio`` or more that share a band.

    A bucket holds the sets with one band key; buckets of the same members count once. A bucket's sets are dealt
    over tiles by hash, tiles meet pairwise in tasks of their own, all pairs are compared by their shingles, and
    a task gives a spanning forest of what it found. Texts that share no band are never read again.
    """
    member = signed.where("n > 0").select("node", "n", F.explode("bands").alias("band")).distinct()
    marks = F.sum(F.xxhash64("node").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("node", F.lit(1)))
    sizes = [F.count("*").alias("many"), F.sum("n").alias("total"), marks[0].alias("sum"), marks[1].alias("xor")]
    buckets = member.groupBy("band").agg(*sizes).where("many > 1")
    tiles = F.greatest(F.ceil(F.col("many") / TILE), F.ceil(F.col("total") / TILE_SHINGLES))
    buckets = buckets.groupBy("many", "total", "sum", "xor").agg(F.min("band").alias("band")).select("band", F.least(tiles, "many").cast("int").alias("tiles"))
    members = written(member.join(buckets, "band").select("band", "tiles", "node"), "bucket-members")
    # one row of each different set that lies in a bucket
    wanted = members.select("node").distinct()
    chosen = signed.groupBy("node").agg(F.min("_row").alias("_row")).join(wanted, "node")
    texts = narrow.join(chosen, "_row").select("node", "_text")
    own = [*fields(signed, node="node"), T.StructField("own", T.ArrayType(T.LongType(), False))]
    sets = written(map_batches(texts, _sets(words), own), "shingle-sets").dropDuplicates(["node"])
    dealt = members.join(sets, "node").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    rows = dealt.groupBy("band", "tile").agg(F.first("tiles").alias("tiles"), F.sort_array(F.collect_list(F.struct("node", "own"))).alias("all"))
    held = written(rows.select("band", "tile", "tiles", F.col("all")["node"].alias("nodes"), F.col("all")["own"].alias("sets")), "shingle-tiles")
    # a tile meets itself in place; only buckets of several tiles are joined
    alone = held.select("nodes", "sets", F.col("nodes").alias("others"), F.col("sets").alias("other_sets"))
    several = held.where("tiles > 1")
    moved = several.where("tile > 0").select("band", F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("tile"), F.col("nodes").alias("others"), F.col("sets").alias("other_sets"))
    across = several.select("band", "tile", "nodes", "sets").join(moved, ["band", "tile"]).select("nodes", "sets", "others", "other_sets")
    return map_batches(alone.unionByName(across), _compare(ratio), "a long, b long")


def fingerprint_links(signed: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that join all different sets whose texts have fingerprints within ``radius`` bits; texts without words have none."""
    owners = written(signed.where("n > 0").select("fp", "node").distinct(), "fingerprints")
    least = owners.groupBy("fp").agg(F.min("node").alias("least"))
    same = owners.join(least, "fp").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    left, right = (least.select(F.col("fp").alias(f"fp_{x}"), F.col("least").alias(x)) for x in ("a", "b"))
    near = alike(owners, radius).toDF("fp_a", "fp_b")
    return same.unionByName(near.join(left, "fp_a").join(right, "fp_b").select("a", "b"))


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, ratio: float = 0.8, radius: int = 3) -> DataFrame:
    """Each row's key, ``_row`` (a hash of the row) and ``root``, the same number for all rows of a group.

    Rows are linked if the SimHash fingerprints of their ``words``-word shingles, repeats included, differ by ``radius`` bits or
    fewer, or if the Jaccard similarity of the sets of these shingles is ``ratio`` or more; groups are what links reach. All
    fingerprints are compared as :func:`simhash.links` does. The similarity is exact; a link by it is overlooked only if the pair
    shares none of the bands. NULL and texts without words are one group. Starts jobs.
    """
    narrow = df.select(F.col(key).alias("_id"), F.xxhash64(key, text).alias("_row"), F.col(text).cast("binary").alias("_text"))
    schema = [*fields(narrow, _id="_id", _row="_row"), *[T.StructField(n, T.LongType()) for n in ("node", "n", "fp")], T.StructField("bands", T.ArrayType(T.LongType(), False))]
    signed = written(map_batches(narrow, _signed(words), schema), "bands")
    found = components(links(signed, narrow, words, ratio).unionByName(fingerprint_links(signed, radius)))
    rooted = signed.select("_id", "_row", "node").join(found, "node", "left")
    return rooted.select(F.col("_id").alias(key), "_row", F.coalesce("root", "node").alias("root"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, ratio: float = 0.8, radius: int = 3) -> DataFrame:
    """The rows of ``df`` without near copies: of each group the row of the smallest key (NULL last) stays.

    All columns are kept, whatever their names. Of rows that repeat key and text one stays. Texts are read whole, whatever their
    length; an empty table stays empty. Starts jobs.
    """
    return first_of_groups(df, written(groups(df, key, text, words, ratio, radius), "groups"), key, text)
