"""Toxicity by non-negative positive-unlabelled learning on word and word-beginning features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.llm.batches import Tokenizer, fields, map_batches, parts

#: Bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Bits of the table that turns most features away before the exact search.
SIEVE_BITS = 22


@dataclass(frozen=True)
class PuConfig:
    """Bounds of the training sample and of the learner.

    At most ``positives`` confirmed and ``unlabelled`` other documents are read for training, the smallest by a
    hash of the id, each of at most ``sample_bytes`` of text (larger ones are not drawn into the sample). ``prior``
    is the share of toxic documents; None takes it from the labelled training rows.
    """

    positives: int = 4096
    unlabelled: int = 8192
    sample_bytes: int = 100_000
    features: int = 1024
    least_count: int = 6
    least_lift: float = 2.5
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4
    prior: float | None = None


def features(column: pa.Array, tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of a column of texts and the row of each, repeats included."""
    tokens = tokenizer(column)
    row = np.repeat(np.arange(len(column)), np.diff(tokens.bounds))
    found = [(tokens.hashes, row)]
    for size in BEGINNINGS:
        hashes, place = tokens.prefix(size)
        found.append((hashes, row[place]))
    return np.concatenate([h for h, _ in found]), np.concatenate([r for _, r in found])


@dataclass
class Model:
    """Feature hashes in order, their weights, and the bias."""

    names: np.ndarray
    weights: np.ndarray
    bias: float

    def sieve(self) -> np.ndarray:
        table = np.zeros(1 << SIEVE_BITS, bool)
        table[(self.names >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        return table

    def present(self, hashes: np.ndarray, rows: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different (row, feature number) pairs among the hashes."""
        if not len(self.names):
            return rows[:0], rows[:0]
        some = np.flatnonzero(sieve[(hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.names, hashes[some]), len(self.names) - 1)
        right = self.names[place] == hashes[some]
        pairs = np.unique(rows[some[right]].astype(np.int64) * len(self.names) + place[right])
        return pairs // len(self.names), pairs % len(self.names)

    def scores(self, column: pa.Array, tokenizer: Tokenizer, sieve: np.ndarray) -> np.ndarray:
        row, place = self.present(*features(column, tokenizer), sieve)
        total = np.bincount(row, self.weights[place], len(column)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _counts(texts: Iterable[pa.Array], tokenizer: Tokenizer, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features (or those of ``among``) and the number of texts that hold each."""
    names, counts = np.zeros(0, np.uint64) if among is None else among, np.zeros(0 if among is None else len(among), np.int64)
    for column in texts:
        hashes, rows = features(column, tokenizer)
        if among is not None and len(names):
            place = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
            right = names[place] == hashes
            pairs = np.unique(rows[right].astype(np.int64) * len(names) + place[right])
            counts += np.bincount(pairs % len(names), minlength=len(names))
        elif among is None:
            order = np.lexsort((rows, hashes))
            hashes, rows = hashes[order], rows[order]
            first = np.ones(len(hashes), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            both = np.concatenate((names, hashes[first]))
            names, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, np.ones(first.sum(), np.int64))), len(names)).astype(np.int64)
    return names, counts


def _chunks(table: pa.Table) -> list[pa.Array]:
    return [part.column("text") for batch in table.to_batches() for part in parts(batch, "text", 1 << 20)]


def nn_pu(x: np.ndarray, u: np.ndarray, prior: float, config: PuConfig) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier by the non-negative positive-unlabelled risk with logistic loss.

    The risk is ``prior * P(loss as 1 on positives) + max(0, P(loss as 0 on unlabelled) - prior * P(loss as 0 on
    positives))``; where the second term is below 0 the step goes up it instead, as its estimate is then fitted
    too closely. ``x`` and ``u`` hold 0 or 1 per feature of positives and unlabelled. Adam on full batches.
    """
    theta = np.zeros(x.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradient(rows: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        return np.append(per_row.astype(rows.dtype) @ rows, per_row.sum()) / len(rows)

    for step in range(1, config.steps + 1):
        weights = theta[:-1].astype(x.dtype)
        at_x, at_u = x @ weights + theta[-1], u @ weights + theta[-1]
        negative = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_x).mean()
        negative_gradient = gradient(u, sigmoid(at_u)) - prior * gradient(x, sigmoid(at_x))
        if negative >= 0:
            slope = prior * gradient(x, sigmoid(at_x) - 1) + negative_gradient
        else:
            slope = -negative_gradient
        slope[:-1] += config.decay * theta[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta -= config.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _matrix(texts: list[pa.Array], model: Model, tokenizer: Tokenizer) -> np.ndarray:
    sieve, out = model.sieve(), []
    for column in texts:
        row, place = model.present(*features(column, tokenizer), sieve)
        block = np.zeros((len(column), len(model.names)), np.float32)
        block[row, place] = 1
        out.append(block)
    return np.concatenate(out) if out else np.zeros((0, len(model.names)), np.float32)


def fit(docs: DataFrame, labels: DataFrame, config: PuConfig = PuConfig(), key: str = "doc_id", text: str = "text", label: str = "toxic", where: Column | None = None) -> Model:
    """Train on confirmed positives (``label`` 1 in ``labels``) and on documents taken as unlabelled.

    ``where`` limits the labels that may be used, by the key. Features are whole words and word beginnings; kept are
    those much commoner among positives than among the unlabelled. The sample, bounded by ``config``, is the only
    thing that reaches the driver. Without positives, or without documents, the model scores the prior (0.1 if there
    are no labels either). Starts jobs.
    """
    usable = labels.where(where) if where is not None else labels
    known = usable.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    prior = config.prior
    if prior is None:
        share = known.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
        prior = 0.1 if share is None else min(0.9, max(1e-3, share))

    def draw(ids: DataFrame, most: int) -> list[pa.Array]:
        few = F.broadcast(ids.select(key).distinct().orderBy(F.xxhash64(F.col(key)), key).limit(most))
        sized = docs.where(F.octet_length(F.col(text)) <= config.sample_bytes)
        table = sized.join(few, key, "left_semi").orderBy(F.xxhash64(F.col(key)), key, text).select(F.col(text).cast("binary").alias("text")).limit(2 * most).toArrow()
        return _chunks(table)

    tokenizer = Tokenizer()
    positive = draw(known.where(F.col(label) == 1), config.positives)
    pool = docs.where(where) if where is not None else docs
    unlabelled = draw(pool.where(F.col(key).isNotNull()), config.unlabelled)
    n_positive, n_unlabelled = sum(map(len, positive)), sum(map(len, unlabelled))
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not n_positive or not n_unlabelled:
        return empty
    names, held = _counts(positive, tokenizer)
    common = held >= min(config.least_count, n_positive)
    names, held = names[common], held[common]
    _, others = _counts(unlabelled, tokenizer, names)
    rate_p, rate_u = held / n_positive, (others + 1) / (n_unlabelled + 1)
    lifted = np.flatnonzero(rate_p > config.least_lift * rate_u)
    strength = (rate_p - rate_u) / np.sqrt(rate_u / n_positive)
    lifted = lifted[np.lexsort((names[lifted], -strength[lifted]))][: config.features]
    model = Model(np.sort(names[lifted]), np.zeros(len(lifted)), empty.bias)
    x, u = _matrix(positive, model, tokenizer), _matrix(unlabelled, model, tokenizer)
    model.weights, model.bias = nn_pu(x, u, prior, config)
    return model


def scored(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row's toxicity: key, the columns of ``keep``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Whole texts are read; NULL and empty texts score as texts without features. Repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored. Nothing is shuffled.
    """
    keep = keep or []
    whole = F.col(text).cast("binary").alias("_text")
    # A kept text crosses to Python once.
    rest = F.struct(F.lit(0).alias("_none"), *[c for c in keep if c != text])
    narrow = df.select(F.col(key).alias("_id"), whole, rest.alias("_rest"))
    shared = df.sparkSession.sparkContext.broadcast((model.names, model.weights, model.bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, own = Tokenizer(), Model(*shared.value)
        sieve = own.sieve()
        for batch in batches:
            for part in parts(batch, "_text", 1 << 20):
                found = own.scores(part.column("_text"), tokenizer, sieve)
                more = [part.column("_text")] if text in keep else []
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(found), part.column("_rest"), *more], names=names)

    names = ["_id", "score", "_rest", *(["_text"] if text in keep else [])]
    schema = [*fields(narrow, _id="_id"), T.StructField("score", T.DoubleType()), narrow.schema["_rest"]]
    out = map_batches(narrow, work, schema + ([T.StructField("_text", T.BinaryType())] if text in keep else []))
    kept = [F.col("_text").cast("string").alias(c) if c == text else F.col("_rest")[c].alias(c) for c in keep]
    return out.select(F.col("_id").alias(key), *kept, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
