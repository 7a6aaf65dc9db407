"""Language-model scores by the marginal likelihood of all subword segmentations under a unigram vocabulary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.llm.batches import blobs, fields, map_batches, mixed, parts
from paceframe.runtime import written

#: The mark that begins each word in a sentencepiece vocabulary.
MARK = "▁"
#: Words that a worker may hold: those counted before they are handed on, and the most frequent ones when scoring.
HELD, HEAD = 200_000, 1 << 18
SIEVE_BITS = 20
BASE = 0x9E3779B97F4A7C15
#: Words times places computed at once.
BLOCK = 1 << 17
TO_LOG10 = float(np.log10(np.e))


@dataclass
class Pieces:
    """An existing vocabulary: pieces in the order of their hashes, then 256 byte pieces, then the end piece.

    ``log_p`` has a natural logarithm for each. A character without a piece of its own is its UTF-8 bytes' pieces.
    """

    hashes: np.ndarray
    sizes: np.ndarray
    log_p: np.ndarray

    @property
    def end(self) -> int:
        return len(self.hashes) + 256

    @classmethod
    def read(cls, file: str) -> Pieces:
        """A sentencepiece vocabulary. Its scores are ranks below 0, so a piece starts with a share of 1 / (1 + rank).

        Control and unknown pieces, and pieces with the word mark behind their first place, are left out: a
        segmentation never crosses words."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): max(0.0, -model.get_score(i)) for i in usable}
        pieces = {p: rank for p, rank in pieces.items() if p and MARK not in p[1:]}
        names = list(pieces)
        hashes = np.array([_hash(p) for p in names], np.uint64)
        order = np.argsort(hashes)
        share = 1 / (1 + np.array([pieces[n] for n in names])[order])
        share = np.concatenate((share, np.full(257, share.min() if len(share) else 1.0)))
        sizes = np.array([len(n) for n in names], np.int64)[order]
        return cls(hashes[order], sizes, np.log(share / share.sum()))

    def with_counts(self, counts: np.ndarray, smoothing: float) -> Pieces:
        share = counts + smoothing
        return Pieces(self.hashes, self.sizes, np.log(share / share.sum()))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _hash(piece: str) -> int:
    codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)
    up, _ = _powers(len(codes))
    return int(mixed(np.array([((mixed(codes + np.uint64(1)) * up).sum(dtype=np.uint64))], np.uint64) + np.uint64(len(codes)))[0])


class Lattice:
    """Forward and backward recursions in log space over the segmentations of many words of one length."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(pieces.hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        self.longest = int(pieces.sizes.max(initial=1))
        self.bytes_p = pieces.log_p[len(pieces.hashes) : len(pieces.hashes) + 256]

    def edges(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size: piece numbers (-1: none; -2: the character's bytes) and log probabilities by word and start."""
        n, width = codes.shape
        up, down = _powers(width + 1)
        sums = np.zeros((n, width + 1), np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * up[:width], axis=1, out=sums[:, 1:])
        out = []
        for size in range(1, min(self.longest, width) + 1):
            hashes = mixed((sums[:, size:] - sums[:, : width + 1 - size]) * down[: width + 1 - size] + np.uint64(size))
            piece = np.full(hashes.shape, -1, np.int32)
            log_p = np.full(hashes.shape, -np.inf)
            some = np.nonzero(self.sieve[(hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
            if len(some[0]) and len(self.pieces.hashes):
                place = np.minimum(np.searchsorted(self.pieces.hashes, hashes[some]), len(self.pieces.hashes) - 1)
                right = (self.pieces.hashes[place] == hashes[some]) & (self.pieces.sizes[place] == size)
                some = some[0][right], some[1][right]
                piece[some] = place[right]
                log_p[some] = self.pieces.log_p[place[right]]
            if size == 1:
                bare = piece < 0
                if bare.any():
                    different, back = np.unique(codes[bare], return_inverse=True)
                    piece[bare] = -2
                    log_p[bare] = np.array([self.bytes_p[list(chr(c).encode("utf-8", "replace"))].sum() for c in different.tolist()])[back]
            out.append((piece, log_p))
        return out

    @staticmethod
    def _sum(parts: list[np.ndarray]) -> np.ndarray:
        if len(parts) == 1:
            return parts[0]
        both = np.stack(parts)
        top = both.max(axis=0)
        return top + np.log(np.exp(both - top).sum(axis=0))

    def forward(self, edges: list, n: int, width: int) -> np.ndarray:
        alpha = np.zeros((width + 1, n))
        columns = [np.ascontiguousarray(p.T) for _, p in edges]
        for i in range(1, width + 1):
            alpha[i] = self._sum([alpha[i - s - 1] + columns[s][i - s - 1] for s in range(min(len(edges), i))])
        return alpha

    def backward(self, edges: list, n: int, width: int) -> np.ndarray:
        beta = np.zeros((width + 1, n))
        columns = [np.ascontiguousarray(p.T) for _, p in edges]
        for i in range(width - 1, -1, -1):
            beta[i] = self._sum([beta[i + s + 1] + columns[s][i] for s in range(min(len(edges), width - i))])
        return beta

    def marginal(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability over all its segmentations."""
        out = np.zeros(len(words))
        for at, codes in self.by_length(words):
            out[at] = self.forward(self.edges(codes), *codes.shape)[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, the words weighted by their counts."""
        total = np.zeros(len(self.pieces.log_p))
        first_byte = len(self.pieces.hashes)
        for at, codes in self.by_length(words):
            n, width = codes.shape
            edges = self.edges(codes)
            alpha, beta = self.forward(edges, n, width), self.backward(edges, n, width)
            for s, (piece, log_p) in enumerate(edges):
                i, j = np.nonzero(piece != -1)
                uses = np.exp(alpha[j, i] + log_p[i, j] + beta[j + s + 1, i] - alpha[width, i]) * counts[at][i]
                known = piece[i, j] >= 0
                total += np.bincount(piece[i, j][known], uses[known], len(total))
                if s == 0 and not known.all():
                    chars, back = np.unique(codes[i, j][~known], return_inverse=True)
                    for c, use in zip(chars.tolist(), np.bincount(back, uses[~known]).tolist(), strict=True):
                        for b in chr(c).encode("utf-8", "replace"):
                            total[first_byte + b] += use
        return total

    @staticmethod
    def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and code points of words of one length, marked as words, in blocks."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            width = int(sizes[order[a]])
            step = max(1, BLOCK // width)
            for c in range(a, b, step):
                at = order[c : min(b, c + step)]
                codes = np.frombuffer("".join([MARK + words[k] for k in at.tolist()]).encode("utf-32-le"), np.uint32)
                yield at, codes.reshape(len(at), width)


def words_of(text: bytes) -> list[bytes]:
    """Runs of anything but space and tab to carriage return, A-Z lower-cased."""
    return text.lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[Counter, Counter] = Counter(), Counter()

    def rows() -> pa.RecordBatch:
        words = list(held[0].keys() | held[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *[pa.array([c[w] for w in words], pa.int64()) for c in held]], names=["word", "c", "other"])
        for c in held:
            c.clear()
        return out

    for batch in batches:
        for part in parts(batch, "_text"):
            for train, raw in zip(part.column("_train").to_pylist(), blobs(part, "_text"), strict=True):
                held[0 if train else 1].update(words_of(raw))
            if len(held[0]) + len(held[1]) > HELD:
                yield rows()
    yield rows()


def word_table(df: DataFrame, train: Column, text: str = "text") -> DataFrame:
    """(word, c, uses): every word of all texts with its uses in the training rows and in all rows."""
    narrow = df.select(train.alias("_train"), F.col(text).cast("binary").alias("_text"))
    some = map_batches(narrow, _count, "word binary, c long, other long")
    return some.groupBy("word").agg(F.sum("c").alias("c"), (F.sum("c") + F.sum("other")).alias("uses"))


def fit(words: DataFrame, texts: int, pieces: Pieces, rounds: int = 2, smoothing: float = 0.1) -> Pieces:
    """Piece probabilities by expectation-maximisation over the training words (word, c) and ``texts`` end pieces.

    Each round sends the pieces to the tasks and their expected uses back, both of the vocabulary's size. Starts jobs.
    """
    context = words.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((pieces.hashes, pieces.sizes, pieces.log_p))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Pieces(*shared.value)
            lattice, total = Lattice(own), np.zeros(len(own.log_p))
            for batch in batches:
                total += lattice.expected([w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()], batch.column("c").to_numpy())
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "uses"])

        uses = map_batches(words.where("c > 0").select("word", "c"), work, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        counts = np.zeros(len(pieces.log_p))
        counts[uses["piece"].to_numpy(np.int64)] = uses["uses"].to_numpy()
        counts[pieces.end] = texts
        pieces = pieces.with_counts(counts, smoothing)
    return pieces


def scored(df: DataFrame, vocabulary: str, train: Column, key: str = "doc_id", text: str = "text", rounds: int = 2) -> DataFrame:
    """Scores of all whole texts: key, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are :func:`words_of` a text and one end. ``score`` is the log10 probability of the text under the subword
    model: piece probabilities start at ``vocabulary`` (a sentencepiece file on the driver) and are fitted to the words of the
    rows where ``train`` is true; a text's probability is the product of its words' marginals over all segmentations
    and the end piece's. ``base_score`` is that of smoothed word counts of the training rows, ``train_tokens`` their
    number, ``n_known`` the text's tokens among them.

    Words are counted once over all texts and scored once each. The ``HEAD`` most used at most, those above 1 / ``HEAD`` of
    all uses, go to every task; each document's other words are shuffled to the word table, where no word has
    more uses than that share.

    NULL and empty texts are the end alone; a NULL ``train`` counts as true. Repeated rows are counted and scored each. An
    empty table gives no rows; other columns are ignored. Starts jobs; tables are written to the shared folder.
    """
    spark = df.sparkSession
    train = F.coalesce(train, F.lit(True))
    raw = written(word_table(df, train, text), "words")
    texts = df.where(train).count()
    facts = raw.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("uses")).first()
    n, v, uses = (facts[0] or 0) + texts, facts[1] + (texts > 0), facts[2] or 0
    pieces = fit(raw, texts, Pieces.read(vocabulary), rounds)
    model = spark.sparkContext.broadcast((pieces.hashes, pieces.sizes, pieces.log_p))
    total = n + 0.5 * (v + 1)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(Pieces(*model.value))
        for batch in batches:
            log_p = lattice.marginal([w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]) * TO_LOG10
            base = np.log10((batch.column("c").to_numpy() + 0.5) / total)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("uses"), pa.array(base), pa.array(log_p)], names=["word", "c", "uses", "base", "log_p"])

    words = written(map_batches(raw.select("word", "c", "uses"), price, "word binary, c long, uses long, base double, log_p double"), "scored-words")
    top = words.where(F.col("uses") * HEAD > uses).toArrow()
    head = spark.sparkContext.broadcast(
        ({w: i for i, w in enumerate(top.column("word").to_pylist())}, *[top.column(c).to_numpy() for c in ("c", "base", "log_p")])
    )
    end = float(np.log10((texts + 0.5) / total)), float(pieces.log_p[pieces.end]) * TO_LOG10, int(texts > 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, c, base, log_p = head.value
        known = (c > 0).astype(np.int64)
        for batch in batches:
            for part in parts(batch, "_text"):
                out: list[tuple] = []
                rest: tuple[list[bytes], list[int], list[int]] = [], [], [0]  # words, their uses, where each text's end
                for raw_text in blobs(part, "_text"):
                    found = Counter(words_of(raw_text))
                    places, times = [], []
                    for word, many in found.items():
                        place = number.get(word)
                        if place is None:
                            rest[0].append(word)
                            rest[1].append(many)
                        else:
                            places.append(place)
                            times.append(many)
                    at, many = np.array(places, np.int64), np.array(times, np.int64)
                    out.append((sum(found.values()) + 1, int(known[at] @ many) + end[2], float(base[at] @ many) + end[0], float(log_p[at] @ many) + end[1]))
                    rest[2].append(len(rest[0]))
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                pairs = pa.StructArray.from_arrays([pa.array(rest[0], pa.binary()), pa.array(rest[1], pa.int64())], names=["word", "n"])
                others = pa.ListArray.from_arrays(pa.array(rest[2], pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_row"), *columns, others], names=["_id", "_row", "n_tokens", "n_known", "base_score", "score", "rest"])

    narrow = df.select(F.col(key).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text).cast("binary").alias("_text"))
    numbers = [T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known")] + [T.StructField(x, T.DoubleType()) for x in ("base_score", "score")]
    rest = T.StructField("rest", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])))
    first = written(map_batches(narrow, score, [*fields(narrow, _id="_id", _row="_row"), *numbers, rest]), "first-scores")
    others = first.select("_row", F.explode("rest").alias("x")).select("_row", "x.word", "x.n").join(words, "word")
    sums = others.groupBy("_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.col("base")).alias("b"), F.sum(F.col("n") * F.col("log_p")).alias("s")
    )
    zero = F.lit(0)
    both = first.drop("rest").join(sums, "_row", "left")
    return both.select(
        F.col("_id").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )
