"""Benchmark decontamination by spaced seeds: hashes at fixed masks meet, overlaps around the hits are verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.llm.batches import Tokenizer, Tokens, fields, map_batches, mixed, parts, folded

#: Token places that a seed reads. One of the two fits without a mismatch into every overlap of 13 tokens or
#: more of which four fifths agree (checked by enumeration for 13 to 25 tokens, which longer overlaps contain).
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5))
SIEVE_BITS = 22
#: Fixed odd factors, one for each place of a seed.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def seeds(tokens: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """The hash at every place of a token sequence where the mask fits."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return tokens[:0]
    total = np.full(n, salt, np.uint64)
    for place, factor in zip(mask, FACTORS, strict=False):
        total += tokens[place : place + n] * factor
    return mixed(total)


@dataclass
class Items:
    """Benchmark items of one block: tokens, their seeds in order, and where each seed lies."""

    names: list
    tokens: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, names: list, texts: list[bytes]) -> Items:
        found = Tokenizer()(pa.array(texts, pa.binary()))
        tokens = [found.hashes[a:b] for a, b in zip(found.bounds, found.bounds[1:], strict=False)]
        seed, item, place = [], [], []
        for i, own in enumerate(tokens):
            for salt, mask in enumerate(MASKS):
                hashes = seeds(own, mask, salt)
                seed.append(hashes)
                item.append(np.full(len(hashes), i))
                place.append(np.arange(len(hashes)))
        if not seed:
            return cls(names, tokens, *[np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)])
        seed, item, place = map(np.concatenate, (seed, item, place))
        order = np.lexsort((place, item, seed))
        return cls(names, tokens, seed[order], item[order], place[order])

    def sieve(self) -> np.ndarray:
        table = np.zeros(1 << SIEVE_BITS, bool)
        table[(self.seed >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        return table


    def short(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each length below a seed's: the hashes of the items of that length in order, and the items."""
        out = []
        for size in range(1, len(MASKS[0])):
            item = np.array([i for i, own in enumerate(self.tokens) if len(own) == size], np.int64)
            if len(item):
                hashes = np.concatenate([seeds(self.tokens[i], tuple(range(size)), size) for i in item])
                order = np.argsort(hashes, kind="stable")
                out.append((size, hashes[order], item[order]))
        return out


def overlap(same: np.ndarray, least: int, ratio: float) -> tuple[int, int] | None:
    """The longest range of at least ``least`` places that starts and ends at an agreement and of whose places
    ``ratio`` or more agree; the first of equals."""
    at = np.flatnonzero(same)
    if len(at) < ratio * least - 1e-9:
        return None
    # Agreements i..j span at[j] - at[i] + 1 places: ratio holds if (j + 1) - ratio * (at[j] + 1) >= i - ratio * at[i].
    start = np.arange(len(at)) - ratio * at
    end = np.arange(1, len(at) + 1) - ratio * (at + 1)
    first = np.searchsorted(-np.minimum.accumulate(start), -(end + 1e-9))  # the leftmost start of every end
    some = np.flatnonzero(first <= np.arange(len(at)))
    length = at[some] - at[first[some]] + 1
    if not len(some) or length.max() < least:
        return None
    begin = int(at[first[some[length == length.max()]]].min())
    return begin, begin + int(length.max())


def _first_places(tokens: Tokens, size: int, known: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, item, place in the text) where a whole item of ``size`` tokens stands first."""
    hashes = seeds(tokens.hashes, tuple(range(size)), size)
    first, last = np.searchsorted(known, hashes), np.searchsorted(known, hashes, "right")
    place = np.flatnonzero(last > first)
    row = np.searchsorted(tokens.bounds, place, "right") - 1
    whole = place + size <= tokens.bounds[row + 1]
    place, row = place[whole], row[whole]
    # the first place of each text and hash, then that hash's items
    _, once = np.unique(np.stack((row, first[place])), axis=1, return_index=True)
    for p, r in zip(place[once].tolist(), row[once].tolist(), strict=True):
        for k in range(first[p], last[p]):
            yield r, int(item[k]), p - int(tokens.bounds[r])


class Diagonals:
    """The different ways to line up the texts of a batch with items: (text, item, place in the text less place in the item)."""

    PAIRS = 1 << 19  # hits that are expanded at a time; repeated tokens give many

    def __init__(self, tokens: Tokens, items: Items) -> None:
        self.tokens, self.items, self.keys = tokens, items, np.zeros(0, np.int64)
        self.before = max(map(len, items.tokens), default=0)
        self.width = self.before + len(tokens.hashes) + 1

    def add(self, row: np.ndarray, item: np.ndarray, shift: np.ndarray) -> None:
        keys = (row * len(self.items.tokens) + item) * self.width + shift + self.before
        self.keys = np.union1d(self.keys, keys)

    def add_hits(self, place: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Places of the batch's tokens whose seed is that of the items' seeds ``first`` to ``last``, exclusive."""
        if not len(place):
            return
        upto = np.cumsum(last - first)
        cuts = np.searchsorted(upto, np.arange(0, upto[-1], self.PAIRS))
        for a, b in zip(cuts, [*cuts[1:], len(place)], strict=True):
            if a == b:
                continue
            n = last[a:b] - first[a:b]
            k = np.arange(n.sum()) + np.repeat(first[a:b] - np.cumsum(n) + n, n)
            r = np.repeat(row[a:b], n)
            self.add(r, self.items.item[k], np.repeat(place[a:b], n) - self.tokens.bounds[r] - self.items.place[k])

    def each(self) -> Iterator[tuple[int, int, list[int]]]:
        """(text, item, shifts in order), in order."""
        pair, shift = np.divmod(self.keys, self.width)
        cuts = np.flatnonzero(np.diff(pair)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pair)], strict=True):
            if a < b:
                r, i = divmod(int(pair[a]), len(self.items.tokens))
                yield r, i, (shift[a:b] - self.before).tolist()


def _find(shared, least: int, ratio: float, short: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        tokenizer, sieve = Tokenizer(), items.sieve()
        whole_items = items.short() if short else []
        for batch in batches:
            for part in parts(batch, "_text", 1 << 20):
                tokens = tokenizer(part.column("_text"))
                lines = Diagonals(tokens, items)
                for salt, mask in enumerate(MASKS):
                    hashes = seeds(tokens.hashes, mask, salt)
                    place = np.flatnonzero(sieve[(hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
                    first, last = np.searchsorted(items.seed, hashes[place]), np.searchsorted(items.seed, hashes[place], "right")
                    hit = last > first
                    place, first, last = place[hit], first[hit], last[hit]
                    row = np.searchsorted(tokens.bounds, place, "right") - 1
                    whole = place + mask[-1] < tokens.bounds[row + 1]
                    lines.add_hits(*(x[whole] for x in (place, row, first, last)))
                for size, known, item in whole_items:
                    short_hits = list(_first_places(tokens, size, known, item))
                    if short_hits:
                        lines.add(*np.array(short_hits, np.int64).T)
                rows = []
                for r, i, shifts in lines.each():
                    own, text = items.tokens[i], tokens.hashes[tokens.bounds[r] : tokens.bounds[r + 1]]
                    best = None
                    for shift in shifts:
                        a, b = max(0, -shift), min(len(own), len(text) - shift)
                        if best is not None and b - a <= best[1] - best[0]:
                            continue  # too short to hold a longer overlap
                        same = own[a:b] == text[a + shift : b + shift]
                        if len(own) < least:
                            found = (0, len(own)) if b - a == len(own) and same.all() else None
                        else:
                            found = overlap(same, least, ratio)
                        if found and (best is None or found[1] - found[0] > best[1] - best[0]):
                            n = int(same[found[0] : found[1]].sum())
                            best = (a + found[0], a + found[1], a + found[0] + shift, n)
                    if best:
                        rows.append((r, items.names[i], best[2], best[2] + best[1] - best[0], best[0], best[3], len(own)))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(columns[0])), part.column("_row").take(pa.array(columns[0])), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.int64()) for c in columns[2:]]], names=NAMES)

    return work


NAMES = ["_id", "_row", "item_id", "start", "end", "item_start", "n_same", "item_tokens"]


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 13, ratio: float = 0.8, block_bytes: int = 32 << 20, short: bool = False) -> DataFrame:
    """Documents that hold benchmark text: one row per document and item, with the longest overlap.

    Columns: key, ``_row`` (a hash of the row), item id (an integer), ``start`` and ``end`` (tokens of the document, end
    exclusive), ``item_start``, ``n_same`` (agreeing tokens), ``item_tokens``. Tokens are runs of letters and digits, A-Z
    lower-cased; an overlap lines a document up with an item without gaps, has ``least`` tokens or more and agrees in at
    least ``ratio`` of them. Items of fewer than ``least`` tokens must appear whole and unchanged; those of fewer than
    five have no seed and are found, by an exact hash of the whole item, only if ``short`` is set.

    The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text (a larger item is a block of its
    own), each against all documents; a benchmark of one block, the usual case, takes one pass without a shuffle.

    NULL and empty texts hold nothing; items with a NULL id or text are left out; repeated documents are each
    reported, repeated items once. Empty tables give no rows; other columns are ignored. Starts a job.
    """
    spark = df.sparkSession
    known = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text")).dropna().distinct()
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    narrow = df.select(F.col(key).alias("_id"), F.xxhash64(key, text).alias("_row"), F.col(text).cast("binary").alias("_text"))
    schema = [*fields(narrow, _id="_id"), *[T.StructField(n, T.LongType()) for n in NAMES[1:]]]
    out = None
    for block in range(blocks):
        own = known.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = Items.of([r["item_id"] for r in own], [bytes(r["text"]) for r in own])
        # plain values, so that workers need not have this package installed
        shared = spark.sparkContext.broadcast((items.names, items.tokens, items.seed, items.item, items.place))
        found = map_batches(narrow, _find(shared, least, ratio, short), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("_id", key)


def without_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that :func:`leaks` does not report, with all their columns, whatever their names. Texts are read whole,
    whatever their length; an empty table stays empty, and an empty benchmark keeps all rows."""
    found = leaks(df, benchmark, key, text, **options).select("_row").distinct()
    narrow, back = folded(df, key, text)
    return back(narrow.withColumn("_row", F.xxhash64(key, text)).join(found, "_row", "left_anti"))
