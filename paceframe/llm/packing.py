"""Vector bin packing of tokenised examples into fixed-length training sequences."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.llm.batches import blobs, fields, map_batches, parts

#: Chunks of text that a worker remembers the ids of, at most, and their longest; ids that examples waiting in a task may have.
REMEMBERED, LONGEST, WAITING = 400_000, 64, 1 << 23


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold at once, and how many waiting pieces a task chooses from."""

    tokens: int = 4096
    segments: int = 128
    loss_tokens: int = 4096
    window: int = 512

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.int64)


class WordIds:
    """Ids of texts, looked up by chunks between spaces and line feeds; only unknown chunks reach the tokenizer.

    Right for tokenizers whose normaliser lower-cases, whose normaliser and word split work on each chunk alone and whose
    words end in a token of their own kind, such as ``word_bpe_49k.json``. A-Z are lower-cased and ASCII marks between one of
    a-z and the end of their chunk are made a chunk of their own before the look-up, which changes no ids and leaves fewer
    different chunks. Chunks of lower-case Latin letters go, many at a time, to the file's model without its slower normaliser.
    A text that holds a special token's name, such as ``<|endoftext|>``, is encoded whole by the tokenizer, which gives the name
    its own id.
    The first ``REMEMBERED`` chunks of at most ``LONGEST`` characters are kept, which soon has all the common ones; the rest are looked
    up again when they come again.
    """

    def __init__(self, file: str) -> None:
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        suffix = self.tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError("the vocabulary has no word ends")
        # a second way into the same model, so its tables are held once
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = Sequence([Split("\n", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [token.content.lower().encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.letters = re.compile("[a-zß-öø-ÿ]+").fullmatch
        # a set of bytes first, which is what a search is quick at
        self.marks = re.compile(rb"[!-/:-@\[-`{-~](?<=[a-z].)[!-/:-@\[-`{-~]*(?=[ \n]|\Z)").sub
        self.known: dict[str, bytes] = {}

    @classmethod
    def of_worker(cls, file: str) -> WordIds:
        """The worker process's own one for the file: workers outlive a task, and with them what they loaded and remember."""
        held = sys.__dict__.setdefault("_paceframe_word_ids", {})
        if file not in held:
            held[file] = cls(file)
        return held[file]

    def _plain(self, text: bytes) -> bytes:
        """Ids of a text whose special tokens' names have their own ids."""
        self.tokenizer.encode_special_tokens = False
        try:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        finally:
            self.tokenizer.encode_special_tokens = True

    def _of_letters(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of lower-case words."""
        for at in range(0, len(words), 100):
            some = words[at : at + 100]
            ids = np.array(self.model.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            flat, last = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(last) != len(some):
                raise ValueError("words and word ends differ in number")
            yield from zip(some, [flat[a:b] for a, b in zip([0, *last], last, strict=False)], strict=True)

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of unknown chunks."""
        letters = {c for c in chunks if self.letters(c)}
        own = dict(self._of_letters(list(letters)))
        whole = list(chunks - letters)
        for at in range(0, len(whole), 500):
            some = whole[at : at + 500]
            for chunk, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                own[chunk] = np.array(found.ids, "<u4").tobytes()
        room = REMEMBERED - len(self.known)
        if room > 0:
            self.known.update(islice(((c, ids) for c, ids in own.items() if len(c) <= LONGEST), room))
        return own

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        known = self.known.get
        lower = [x.lower() for x in texts]
        named = [i for name in self.special for i, x in enumerate(lower) if name in x]
        for i in named:
            lower[i] = b""
        apart = [self.marks(rb" \g<0>", x) for x in lower]
        chunks = [x.decode("utf-8", "replace").replace("\n", " ").split(" ") for x in apart]
        found = [list(map(known, x)) for x in chunks]
        unknown = {c for x, ids in zip(chunks, found, strict=True) if None in ids for c, one in zip(x, ids, strict=True) if one is None}
        if unknown:
            own = self._learn(unknown)
            found = [[own[c] if one is None else one for c, one in zip(x, ids, strict=True)] if None in ids else ids for x, ids in zip(chunks, found, strict=True)]
        out = [b"".join(ids) for ids in found]
        for i in named:
            out[i] = self._plain(texts[i])
        return out


@dataclass
class Piece:
    """A run of an example's ids and its demands: tokens, segments, loss-bearing tokens."""

    example: int
    start: int
    tokens: int
    loss: int


class Packer:
    """Fills one sequence after another from a window of waiting examples.

    The example that fits and whose demands have the largest dot product with what is left of the limits
    (both as shares of the limits) goes in next. If examples may be cut, the head of the best one fills what
    the sequence has left when no whole example fits, and a sequence that ends early (at the segment limit, or with
    the input) is cut into sequences whose lengths are powers of two, so it needs no padding.
    """

    def __init__(self, limits: Limits, cut: bool, first_id: int) -> None:
        self.limits, self.cut, self.sequence = limits, cut, first_id
        self.total = limits.array().astype(np.float64)
        self.free = limits.array()
        self.open: list[Piece] = []
        self.pieces: list[Piece] = []
        self.demands = np.zeros((0, 3), np.int64)
        self.done: list[tuple[int, int, int, int, int]] = []
        self.waiting = 0

    def add(self, example: int, tokens: int, loss: int) -> None:
        """Take one more example of ``tokens`` ids, the last ``loss`` of which bear loss."""
        if not tokens:
            return
        if not self.cut and (tokens > self.limits.tokens or loss > self.limits.loss_tokens):
            raise ValueError("an example is over the limits and may not be cut")
        self.pieces.append(Piece(example, 0, tokens, loss))
        self.waiting += tokens
        if len(self.pieces) >= 2 * self.limits.window or self.waiting > WAITING:
            self._pack(min(self.limits.window, len(self.pieces) // 2))
            self.waiting = sum(p.tokens for p in self.pieces)

    def _pack(self, leave: int) -> None:
        """Place waiting examples until ``leave`` wait."""
        self.demands = np.array([(p.tokens, 1, p.loss) for p in self.pieces], np.int64).reshape(-1, 3)
        shares = self.demands / self.total
        waiting = np.ones(len(self.pieces), bool)
        left = len(self.pieces)
        while left > leave:
            scores = shares @ (self.free / self.total)
            fits = waiting & (self.demands <= self.free).all(1)
            if fits.any():
                best = int(np.where(fits, scores, -1).argmax())
                self._place(self.pieces[best])
                waiting[best] = False
                left -= 1
            elif self.cut and (self.free > 0).all():
                best = int(np.where(waiting, scores, -1).argmax())
                piece = self.pieces[best]
                head = int(min(self.free[0], piece.tokens - 1))
                while head and head - max(0, piece.tokens - piece.loss) > self.free[2]:
                    head = int(self.free[2] + max(0, piece.tokens - piece.loss))
                quiet = piece.tokens - piece.loss
                bearing = max(0, head - quiet)
                self._place(Piece(piece.example, piece.start, head, bearing))
                self.pieces[best] = Piece(piece.example, piece.start + head, piece.tokens - head, piece.loss - bearing)
                self.demands[best] = (piece.tokens - head, 1, piece.loss - bearing)
                shares[best] = self.demands[best] / self.total
            else:
                self._close()
            if not self.free[0]:
                self._close()
        self.pieces = [p for p, w in zip(self.pieces, waiting, strict=True) if w]

    def _place(self, piece: Piece) -> None:
        self.open.append(piece)
        self.free = self.free - (piece.tokens, 1, piece.loss)

    def _close(self) -> None:
        """End the open sequence; one that needs padding is cut into powers of two, if that is allowed."""
        length = sum(p.tokens for p in self.open)
        if not self.cut or length == self.limits.tokens:
            self._write(self.open)
        else:
            rest = list(self.open)
            for size in (1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1):
                head = []
                while size:
                    p = rest.pop(0)
                    take = min(size, p.tokens)
                    head.append(Piece(p.example, p.start, take, 0))
                    if take < p.tokens:
                        rest.insert(0, Piece(p.example, p.start + take, p.tokens - take, 0))
                    size -= take
                self._write(head)
        self.open, self.free = [], self.limits.array()

    def _write(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.done.append((p.example, p.start, p.tokens, self.sequence, offset))
            offset += p.tokens
        self.sequence += bool(pieces)

    def finish(self) -> None:
        """Place all that waits and close the last sequence."""
        self._pack(0)
        self._close()


def _pack(encode: Callable[[], Callable], limits: Limits, cut: bool, end: bytes):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = encode()
        packer = Packer(limits, cut, TaskContext.get().partitionId() << 40)
        waiting: dict[int, list] = {}  # example: its key, ids, ids not yet placed
        count = 0

        def placed() -> pa.RecordBatch | None:
            rows = []
            for example, start, length, sequence, offset in packer.done:
                held = waiting[example]
                rows.append((held[0], start, length, zlib.crc32(held[1][4 * start : 4 * (start + length)]), len(held[1]) // 4, sequence, offset))
                held[2] -= length
                if not held[2]:
                    del waiting[example]
            packer.done = []
            if not rows:
                return None
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=NAMES)

        for batch in batches:
            kind = batch.schema.field("_id").type
            for part in parts(batch, "_text"):
                for key, ids in zip(part.column("_id").to_pylist(), ids_of(blobs(part, "_text")), strict=True):
                    ids += end
                    n = len(ids) // 4
                    waiting[count] = [key, ids, n]
                    packer.add(count, n, max(0, n - 1))
                    count += 1
                if (out := placed()) is not None:
                    yield out
        packer.finish()
        if (out := placed()) is not None:
            yield out

    return work


NAMES = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(df: DataFrame, vocabulary: str, end_id: int = 2, limits: Limits = Limits(), cut: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all rows' token ids into sequences; one row per piece: key, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``.

    ``vocabulary`` names a tokenizer file for :class:`WordIds` that every executor can read; each example is its text's ids
    and ``end_id``. All but an example's first id bear loss. A sequence keeps within ``limits`` at once. Each task
    packs its own input split, holding at most two windows of examples, so nothing is shuffled; ``sequence_id`` is
    unique, not gapless. A task repeated elsewhere gives the same pieces.

    NULL and empty texts are the end id alone. Repeated rows are packed each. An empty table gives no rows; other
    columns are ignored.
    """
    narrow = df.select(F.col(key).alias("_id"), F.col(text).cast("binary").alias("_text"))
    schema = [*fields(narrow, _id="_id"), *[T.StructField(n, T.LongType()) for n in NAMES[1:]]]
    out = map_batches(narrow, _pack(lambda: WordIds.of_worker(vocabulary), limits, cut, np.array([end_id], "<u4").tobytes()), schema)
    return out.withColumnRenamed("_id", key)


def pack_examples(df: DataFrame, key: str, tokens: str, loss: str, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """Pack examples that are tokenised already, such as instruction data: columns with their numbers of ids and of
    loss-bearing ids (the last ones). One row per piece: key, ``start``, ``length``, ``loss_length``, ``sequence_id``,
    ``offset``. Rows without ids, or NULL, are left out; an uncut example over a limit is an error."""
    narrow = df.select(F.col(key).alias("_id"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.col(loss), F.lit(0)).cast("long").alias("loss"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(limits, cut, TaskContext.get().partitionId() << 40)
        waiting: dict[int, list] = {}
        count, kind = 0, None

        def placed() -> pa.RecordBatch:
            rows = []
            for example, start, length, sequence, offset in packer.done:
                held = waiting[example]
                bearing = max(0, min(length, start + length - (held[1] - held[2])))
                rows.append((held[0], start, length, bearing, sequence, offset))
                held[3] -= length
                if not held[3]:
                    del waiting[example]
            packer.done = []
            columns = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["_id", "start", "length", "loss_length", "sequence_id", "offset"])

        for batch in batches:
            kind = batch.schema.field("_id").type
            for i, n, bearing in zip(*(batch.column(c).to_pylist() for c in ("_id", "tokens", "loss")), strict=True):
                if n > 0:
                    waiting[count] = [i, n, min(n, max(0, bearing)), n]
                    packer.add(count, n, waiting[count][2])
                    count += 1
            yield placed()
        packer.finish()
        if packer.done:
            yield placed()

    schema = [*fields(narrow, _id="_id"), *[T.StructField(n, T.LongType()) for n in ("start", "length", "loss_length", "sequence_id", "offset")]]
    return map_batches(narrow, work, schema).withColumnRenamed("_id", key)
