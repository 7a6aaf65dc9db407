"""Record-batch helpers of the text operators: bounded slices and hashed tokens in NumPy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.runtime import shared_dir

#: Fixed odd multiplier and seed of the rolling token hash; any odd 64-bit number will do.
BASE = np.uint64(0x9E3779B97F4A7C15)
SEED = 20240607


def fields(df: DataFrame, **columns: str) -> list[T.StructField]:
    """Schema fields holding the types of existing columns under new names."""
    return [T.StructField(name, df.schema[old].dataType) for name, old in columns.items()]


def folded(df: DataFrame, *apart: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but those ``apart`` in one struct, ``_folded``, and the way back to the columns of ``df``.

    Between the two no other name of ``df`` can clash with a column that an operator adds.
    """
    rest = {c: f"c{i}" for i, c in enumerate(df.columns) if c not in apart}
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in df.columns}
    fold = F.struct(F.lit(0).alias("none"), *[quoted[c].alias(n) for c, n in rest.items()]).alias("_folded")

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col("_folded")[rest[c]].alias(c) if c in rest else quoted[c] for c in df.columns])

    return df.select(*[quoted[c] for c in apart], fold), back


def map_batches(df: DataFrame, work: Callable, schema: list[T.StructField] | str) -> DataFrame:
    """``mapInArrow`` with a list of fields or a DDL string as the schema."""
    return df.mapInArrow(work, T.StructType(schema) if isinstance(schema, list) else schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder; keeps the splits and their order. Starts a job."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's own content, the same wherever the row is read; never NULL."""
    return F.xxhash64(*[F.col(c) for c in columns])


def parts(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    groups = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(start, end - start)


def blobs(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The bytes of a binary column; NULL counts as empty."""
    return [x or b"" for x in batch.column(column).to_pylist()]


@dataclass
class Tokens:
    """Hashed tokens of several texts, one after the other.

    A token is a run of ASCII letters and digits (A-Z as a-z) and of bytes above 127; all else
    separates. ``bounds[i]:bounds[i + 1]`` are the tokens of text ``i``. ``sums`` and ``unpower``
    give the hash of any byte range: ``(sums[b] - sums[a]) * unpower[a]``.
    """

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray
    unpower: np.ndarray

    def prefix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``size`` bytes of the tokens that are longer, and those tokens' places."""
        long = np.flatnonzero(self.ends - self.starts > size)
        start = self.starts[long]
        return mixed((self.sums[start + size] - self.sums[start]) * self.unpower[start] + np.uint64(size)), long


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokenizer:
    """Turns a binary Arrow column into :class:`Tokens`; keeps the powers it has computed."""

    def __init__(self) -> None:
        byte = np.arange(256)
        upper = (byte >= 65) & (byte <= 90)
        lower = np.where(upper, byte + 32, byte)
        inside = ((lower >= 97) & (lower <= 122)) | ((byte >= 48) & (byte <= 57)) | (byte > 127)
        weights = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.weights = np.where(inside, weights[lower], np.uint64(0)).astype(np.uint64)
        self.inside = inside
        self.power = self.unpower = np.ones(1, np.uint64)

    def powers(self, size: int) -> None:
        if len(self.power) < size:
            size = max(size, 2 * len(self.power))
            factors = np.full(size, BASE)
            factors[0] = 1
            self.power = np.cumprod(factors)
            factors[1:] = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.unpower = np.cumprod(factors)

    def __call__(self, column: pa.Array) -> Tokens:
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        n = len(raw)
        self.powers(n + 1)
        inside = self.inside[raw]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        before = np.concatenate(([False], inside[:-1])) if n else inside
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.concatenate((inside[1:], [False])) if n else inside
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.weights[raw] * self.power[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.unpower[starts])
        return Tokens(hashes, np.searchsorted(starts, at), starts, ends, sums, self.unpower)
