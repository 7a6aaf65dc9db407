"""Alignment of two tokenizers over the same bytes: groups of tokens between common ends, and how often ids end together."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.llm.batches import blobs, fields, map_batches, parts
from paceframe.runtime import written

#: Id pairs that may be sent to every task, and bytes of chunks that a worker remembers.
HEAD, REMEMBERED = 1 << 18, 144 << 20
#: Pairs that a task counts at once.
COUNTED = 1 << 21
#: Bits of the second id in a pair's number; what stands before an id in the written groups.
LOW = 32
MARKS = np.array([",", ";", "|"], object)

#: A chunk's numbers of first, second and shared ends, its groups as text and its linked pairs; None if its bytes differ.
Entry = tuple[int, int, int, str, bytes] | None


def byte_of_symbol() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as printable characters: visible Latin-1 stands for itself, the other
    bytes for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_ends(spans: np.ndarray, sure: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where tokens end, in bytes: at the end of their span where that is sure, else as many decoded bytes after the last
    sure end as the tokens since then hold."""
    total = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(sure)), -1))
    base = np.where(last >= 0, spans[last] - total[last], 0)
    return np.where(sure, spans, base + total)


class Aligner:
    """Encodes texts with a byte-level BPE file (first) and a sentencepiece file (second) and finds their common ends.

    The first encodes a space and the text, the second, which adds that space itself, the text; names of special tokens
    are plain text. Both never join over a single space between two other characters, so a text is cut there into chunks and
    a chunk's alignment is remembered, up to ``REMEMBERED`` bytes a worker; all others are encoded again.
    """

    def __init__(self, first: str, second: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        symbols = byte_of_symbol()
        vocabulary = self.first.get_vocab(with_added_tokens=False)
        self.first_bytes = [b""] * (1 + max(self.first.get_vocab().values()))
        for token, i in vocabulary.items():
            self.first_bytes[i] = bytes(symbols[c] for c in token)
        n = self.second.get_piece_size()
        self.fallback = np.array([self.second.is_byte(i) for i in range(n)])
        pieces = [self.second.id_to_piece(i) for i in range(n)]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, self.fallback.tolist(), strict=True)]
        self.first_sizes, self.second_sizes = (np.array([len(x) for x in table]) for table in (self.first_bytes, self.second_bytes))
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.inner = re.compile(r"\S(?:.*\S)?", re.S).fullmatch
        # Worker processes outlive a task, and with them what they remember: chunks, and their bytes.
        self.memory = sys.__dict__.setdefault("_paceframe_alignments", {}).setdefault((first, second), [{}, 0])

    def _ends(self, text: str, found, pieces) -> tuple[list[int], list[int], np.ndarray, np.ndarray] | None:
        """Ids and byte ends of both sides of one encoded text; None if the bytes of either differ from the text's."""
        raw = text.encode()
        a = found.ids
        b = [p.id for p in pieces]
        if b"".join(map(self.first_bytes.__getitem__, a)) != raw or b"".join(map(self.second_bytes.__getitem__, b)) != raw:
            return None
        offsets = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            place = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))))
            offsets = place[offsets]
        # A character whose bytes several tokens share is the start of the next token too.
        whole = np.append(offsets[:-1, 1] == offsets[1:, 0], True)
        first = byte_ends(offsets[:, 1], whole, self.first_sizes[a])
        ids = np.array(b)
        spans = np.fromiter((p.end for p in pieces), np.int64, len(b))
        second = byte_ends(spans + 1, ~self.fallback[ids], self.second_sizes[ids])
        return a, b, first, second

    def entries(self, text: str, found, pieces, ends: list[int]) -> list[Entry] | None:
        """Alignments of the chunks of one encoded text that end at the given bytes; None if one of them is no common end."""
        sides = self._ends(text, found, pieces)
        if sides is None:
            return None
        a, b, first, second = sides
        shared, at, bt = np.intersect1d(first, second, assume_unique=True, return_indices=True)
        last = np.searchsorted(shared, ends)
        if (last >= len(shared)).any() or (shared[last] != ends).any():
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        linked = (a[at] << LOW | b[bt]).tobytes()
        at, bt = np.append(0, at + 1), np.append(0, bt + 1)  # a group's tokens on either side
        group_a, group_b = np.searchsorted(shared, first), np.searchsorted(shared, second)
        place_a, place_b = np.arange(len(a)) + bt[group_a], np.arange(len(b)) + at[group_b + 1]
        order, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), 0)
        order[place_a], order[place_b] = a, b
        marks[place_a[at[:-1]]], marks[place_b[bt[:-1]]] = 1, 2
        written_out = [""] * (2 * len(order))
        written_out[0::2], written_out[1::2] = MARKS[marks].tolist(), map(str, order.tolist())
        out = []
        for start, end in pairwise([0, *(last + 1).tolist()]):
            n_a, n_b = int(at[end] - at[start]), int(bt[end] - bt[start])
            begin = 2 * int(at[start] + bt[start])
            out.append((n_a, n_b, end - start, "".join(written_out[begin + 1 : begin + 2 * (n_a + n_b)]), linked[8 * start : 8 * end]))
        return out

    def _encoded(self, texts: list[str]) -> Iterator[tuple]:
        whole = self.first.encode_batch(texts, add_special_tokens=False)
        spans = self.second.encode([t[1:] for t in texts], return_type="proto", num_threads=1)
        return zip(texts, whole, (s.pieces for s in spans), strict=True)

    def _learn(self, chunks: set[str]) -> dict[str, Entry]:
        """Alignments of chunks; those without white space at their ends are encoded many at a time."""
        own: dict[str, Entry] = {}
        alone = [c for c in chunks if not self.inner(c)]
        many, held, size = [], [], 0
        for chunk in chunks.difference(alone):
            held.append(chunk)
            size += len(chunk) + 1
            if size > 4096:
                many.append(held)
                held, size = [], 0
        if held:
            many.append(held)
        for at in range(0, len(many), 16):
            some = many[at : at + 16]
            texts = [" " + " ".join(x) for x in some]
            for held, (text, found, pieces) in zip(some, self._encoded(texts), strict=True):
                ends = np.cumsum([len(c.encode()) + 1 for c in held])
                entries = self.entries(text, found, pieces, ends.tolist())
                if entries is None:
                    alone += held
                else:
                    own.update(zip(held, entries, strict=True))
        for at in range(0, len(alone), 64):
            some = alone[at : at + 64]
            for chunk, (text, found, pieces) in zip(some, self._encoded([" " + c for c in some]), strict=True):
                entries = self.entries(text, found, pieces, [len(text.encode())])
                own[chunk] = entries[0] if entries else None
        known, used = self.memory
        for chunk, entry in own.items():
            cost = 300 + len(chunk) + (len(entry[3]) + len(entry[4]) if entry else 0)
            if used + cost <= REMEMBERED:
                known[chunk] = entry
                used += cost
        self.memory[1] = used
        return own

    def __call__(self, texts: list[bytes]) -> list[Entry]:
        """Each text's alignment; None where it is empty, no UTF-8, or the bytes of a side differ."""
        known = self.memory[0]
        chunks = [self.cut(x.decode()) if x else [] for x in texts]
        unknown = {c for x in chunks for c in x if c not in known}
        own = self._learn(unknown) if unknown else {}
        out: list[Entry] = []
        for x in chunks:
            entries = [own[c] if c in own else known[c] for c in x]
            if not entries or None in entries:
                out.append(None)
                continue
            a, b, n, groups, linked = zip(*entries, strict=True)
            out.append((sum(a), sum(b), sum(n), ";".join(groups), b"".join(linked)))
        return out


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def groups(df: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text's alignment: key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, ``pairs``, ``times``.

    ``first`` is a byte-level BPE file and ``second`` a sentencepiece file that every executor can read. Both encode a space
    and the text without special tokens. Byte offsets where tokens of both end cut them into groups, written as
    ``a1,a2|b1;a3|b2,b3``; the two tokens that end there are linked. ``pairs`` are the different linked ids
    (first << 32 | second) and ``times`` how often each is linked in the text.

    NULL and empty texts, and texts whose decoded tokens on either side are not the space and the text (such as one with
    U+2581), have no tokens: zeros, an empty string, empty lists. Texts are aligned whole, whatever their length; a long one is
    held once, by one task. Repeated rows are aligned each; an empty table gives no rows; other columns are ignored. Lazy.
    """
    narrow = df.select(F.col(key).alias("_id"), F.col(text).cast("binary").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(first, second)
        for batch in batches:
            for part in parts(batch, "_text"):
                entries = [e or (0, 0, 0, "", b"") for e in align(blobs(part, "_text"))]
                counted = [np.unique(np.frombuffer(e[4], np.int64), return_counts=True) for e in entries]
                numbers = [pa.array(x, pa.int64()) for x in zip(*((e[0], e[1], e[2], len(e[4]) // 8) for e in entries), strict=True)]
                lists = [_lists([c[i] for c in counted], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *numbers, pa.array([e[3] for e in entries], pa.string()), *lists], names=["_id", *COUNTS, "groups", "pairs", "times"])

    longs = T.ArrayType(T.LongType())
    schema = [*fields(narrow, _id="_id"), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups", T.StringType()), T.StructField("pairs", longs), T.StructField("times", longs)]
    return map_batches(narrow, work, schema).withColumnRenamed("_id", key)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of the lists, in runs of bounded size."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def rows() -> pa.RecordBatch:
        pair, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, back, np.concatenate([h[1] for h in held]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    for batch in batches:
        held.append(tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times")))
        size += len(held[-1][0])
        if size > COUNTED:
            yield rows()
            size = 0
    if held:
        yield rows()


def pair_counts(grouped: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``pair``, ``n``, ``best``) of all linked id pairs: links over all rows of :func:`groups`, and whether no pair with the
    same second id has more. The best counts are one row per id of the second vocabulary, so they are broadcast."""
    raw = map_batches(grouped.select("pairs", "times"), _count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << LOW) - 1))
    counts = written(raw.select(F.shiftright("pair", LOW).alias("a"), b.alias("b"), "pair", "n"), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select("a", "b", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _price(head) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = head.value
        for batch in batches:
            flat, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            sizes = np.diff(batch.column("pairs").offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
            hit = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row[hit], times[hit] * n[at[hit]])
            np.add.at(n_best, row[hit], times[hit] * best[at[hit]])
            starts = np.concatenate(([0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows)))).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x[~hit])) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(n_best), pa.array(total), *rest], names=["_row", "n_best", "count_sum", "pairs", "times"])

    return work


def with_counts(grouped: DataFrame) -> DataFrame:
    """The rows of :func:`groups`, columns added or dropped, without ``pairs`` and ``times`` and with ``n_best`` and ``count_sum``.

    An id pair's count is the number of links over all rows that hold it. ``count_sum`` adds the counts of a row's links,
    ``n_best`` counts those of them whose count is the highest of their second id, ties included.

    The rows are written once. Pairs above 1 / ``HEAD`` of all links, so at most that many, go to every task; each
    row's other pairs are shuffled to the table of counts, where no pair has more uses than that share. An empty table
    gives no rows. Starts jobs.
    """
    spark = grouped.sparkSession
    kept = written(grouped.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    priced = written(pair_counts(kept), "priced-pairs")
    links = priced.agg(F.sum("n")).first()[0] or 0
    top = priced.where(F.col("n") * HEAD > links).select("pair", "n", F.col("best").cast("long").alias("best")).toArrow().sort_by("pair")
    head = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    first = map_batches(kept.select("_row", "pairs", "times"), _price(head), "_row long, n_best long, count_sum long, pairs array<long>, times array<long>")
    first = written(first, "priced-links")
    rest = first.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", "x.pairs", "x.times")
    found = rest.join(priced, F.col("pairs") == F.col("pair"))
    more = found.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    sums = first.drop("pairs", "times").join(more, "_row", "left").select(
        "_row", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum")
    )
    return kept.drop("pairs", "times").join(sums, "_row").drop("_row")
