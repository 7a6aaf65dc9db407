"""Reversible line dedup: exact reference counts per line, with a cuckoo filter per shard in front of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.llm.batches import blobs, fields, map_batches, parts, row_key
from paceframe.runtime import written

SLOTS, KICKS, LOAD = 4, 500, 0.8
COUNTS = "shard int, k1 long, k2 long, n_docs long"
FILTERS = "shard int, filter binary"


def line_key(line: bytes) -> bytes:
    """The line without white space (space, tab to carriage return) at its ends, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _key_hash(key: bytes) -> tuple[int, int]:
    """Two signed 64-bit halves of the key's 128-bit hash."""
    h = xxhash.xxh3_128_digest(key)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _other(bucket: np.ndarray, mark: np.ndarray, buckets: int) -> np.ndarray:
    """The second bucket of a mark; the second of the second is the first."""
    return bucket ^ (mark * 0x5BD1E995 & (buckets - 1))


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Of rows sorted by the columns: the number of equal rows before each."""
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(new)
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def _nth(those: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row, where the true value number ``n`` stands, and whether there is one."""
    enough = n < those.sum(axis=1)
    place = np.argsort(~those, axis=1, kind="stable")
    return place[np.arange(len(n)), np.where(enough, n, 0)], enough


def _place(table: np.ndarray, mark: np.ndarray, bucket: np.ndarray) -> bool:
    """Put all marks into one of their buckets; whether it went. If not, the table is spoilt."""
    rng = np.random.default_rng(len(mark))
    for turn in range(KICKS):
        order = np.argsort(bucket, kind="stable")
        mark, bucket = mark[order], bucket[order]
        slot, fits = _nth(table[bucket] == 0, _ranks(bucket))
        table[bucket[fits], slot[fits]] = mark[fits]
        mark, bucket = mark[~fits], bucket[~fits]
        if not len(mark):
            return True
        if turn:  # neither bucket has room: one of each bucket changes places with a mark that lies there
            lead = np.flatnonzero(_ranks(bucket) == 0)
            slot = rng.integers(SLOTS, size=len(lead))
            lying = table[bucket[lead], slot].astype(np.int64)
            table[bucket[lead], slot] = mark[lead]
            mark[lead] = lying
        bucket = _other(bucket, mark, len(table))
    return False


class CuckooFilter:
    """A set of 128-bit keys with deletion: 16-bit fingerprints, four to a bucket, in a chain of tables.

    A key lies in one of two buckets; a full pair moves others about. Keys are placed all at once, in rounds over sorted
    buckets. A table is made for the keys that come, so one build is one table; keys that would fill the newest table beyond
    ``LOAD``, or that find no place in ``KICKS`` rounds, get a table of their own of at least twice its size, so a chain is as
    long as the logarithm of its keys, but for keys whose marks and buckets agree. No false negatives; false positives are rare.
    """

    def __init__(self, tables: list[np.ndarray] | None = None) -> None:
        self.tables = tables if tables is not None else [np.zeros((64, SLOTS), np.uint16)]

    @staticmethod
    def _marks(k1: np.ndarray, k2: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (k2.view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.int64)
        first = k1 & (buckets - 1)
        return mark, first, _other(first, mark, buckets)

    def add(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Add keys that are not there yet."""
        if not len(k1):
            return
        if self.tables and np.count_nonzero(self.tables[-1]) + len(k1) <= LOAD * self.tables[-1].size:
            table = self.tables[-1].copy()
            if _place(table, *self._marks(k1, k2, len(table))[:2]):
                self.tables[-1] = table
                return
        self._new_table(k1, k2, 2 * len(self.tables[-1]) if self.tables else 64)

    def _new_table(self, k1: np.ndarray, k2: np.ndarray, buckets: int) -> None:
        buckets = max(buckets, 1 << int(len(k1) / (LOAD * SLOTS)).bit_length())
        mark, first, second = self._marks(k1, k2, buckets)
        low, high = np.minimum(first, second), np.maximum(first, second)
        order = np.lexsort((mark, high, low))
        # more keys of one mark and one pair of buckets than a bucket holds: the rest get a further table
        fit = np.empty(len(k1), bool)
        fit[order] = _ranks(low[order], high[order], mark[order]) < SLOTS
        while not _place(table := np.zeros((buckets, SLOTS), np.uint16), *self._marks(k1[fit], k2[fit], buckets)[:2]):
            buckets *= 2
        self.tables.append(table)
        if not fit.all():
            self._new_table(k1[~fit], k2[~fit], buckets)

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take out keys that were added. A mark in a larger table stands for the same buckets in the smaller ones, so which of
        two keys with the same mark and buckets goes makes no difference."""
        for table in reversed(self.tables):
            mark, first, second = self._marks(k1, k2, len(table))
            low, high = np.minimum(first, second), np.maximum(first, second)
            order = np.lexsort((mark, high, low))
            mark, low, high, k1, k2 = (x[order] for x in (mark, low, high, k1, k2))
            held = np.concatenate((table[low] == mark[:, None], (table[high] == mark[:, None]) & (low != high)[:, None]), axis=1)
            # the n-th key of a mark and pair of buckets takes out the n-th such mark
            place, found = _nth(held, _ranks(low, high, mark))
            bucket = np.where(place < SLOTS, low, high)
            table[bucket[found], place[found] % SLOTS] = 0
            k1, k2 = k1[~found], k2[~found]
        if len(k1):
            raise KeyError("a key to remove is not in the filter")

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(k1), bool)
        for table in self.tables:
            mark, first, second = self._marks(k1, k2, len(table))
            found |= (table[first] == mark[:, None]).any(1) | (table[second] == mark[:, None]).any(1)
        return found

    def to_bytes(self) -> bytes:
        head = np.array([len(self.tables), *map(len, self.tables)], np.int64)
        return head.tobytes() + b"".join(t.tobytes() for t in self.tables)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes = np.frombuffer(raw, np.int64, n, 8)
        flat = np.frombuffer(raw, np.uint16, offset=8 * (n + 1)).copy()
        return cls([x.reshape(-1, SLOTS) for x in np.split(flat, np.cumsum(sizes * SLOTS)[:-1])] if n else [])


def _doc_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different line keys of each text, hashed; empty keys are left out."""
    for batch in batches:
        for part in parts(batch, "_text"):
            rows, keys = [], []
            for rid, raw in zip(part.column("_rid").to_pylist(), blobs(part, "_text"), strict=True):
                if not raw:
                    continue
                different = set(map(line_key, raw.split(b"\n")))
                different.discard(b"")
                rows += [rid] * len(different)
                keys += [xxhash.xxh3_128_digest(k) for k in different]
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], names=["rid", "k1", "k2"])


def _update_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard, in order: its filter, keys that became rare, keys that became frequent; gives the new filters."""
    shard, cuckoo, changes = None, CuckooFilter([]), ([], [])

    def finished() -> pa.RecordBatch:
        for work, keys in zip((cuckoo.remove, cuckoo.add), changes, strict=True):
            if keys:
                work(*map(np.concatenate, zip(*keys, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([cuckoo.to_bytes()], pa.binary())], names=["shard", "filter"])

    for batch in batches:
        own, kind, k1, k2 = (batch.column(n).fill_null(0).to_numpy(zero_copy_only=False) for n in ("shard", "kind", "k1", "k2"))
        cuts = [0, *(np.flatnonzero((np.diff(own) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if own[a] != shard:
                if shard is not None:
                    yield finished()
                shard, cuckoo, changes = int(own[a]), CuckooFilter([]), ([], [])  # no table yet: the first is made for its keys
            if kind[a] == 0:
                cuckoo = CuckooFilter.from_bytes(batch.column("filter")[a].as_py())
            else:
                changes[kind[a] - 1].append((k1[a:b], k2[a:b]))
    if shard is not None:
        yield finished()


class LineIndex:
    """Lines by the number of documents that hold them, and filters of those in ``min_docs`` or more.

    ``counts`` has the exact number of documents of every line (128-bit hash of its key), dealt over
    ``shards`` by hash; ``filters`` has one cuckoo filter per shard with the frequent lines. Both are tables
    in the shared folder. :meth:`insert` and :meth:`delete` give a new index; the old one stays valid, and
    deleting what was inserted gives back the same counts and the same answers.
    """

    def __init__(self, counts: DataFrame, filters: DataFrame, min_docs: int, shards: int) -> None:
        self.counts, self.filters, self.min_docs, self.shards = counts, filters, min_docs, shards

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int = 10, shards: int | None = None) -> LineIndex:
        """An index of no documents; ``shards`` defaults to the session's shuffle partitions."""
        shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cls(spark.createDataFrame([], COUNTS), spark.createDataFrame([], FILTERS), min_docs, shards)

    def lines(self, docs: DataFrame, text: str = "text", rid=None) -> DataFrame:
        """(rid, k1, k2, shard): each document's different lines."""
        narrow = docs.select((F.lit(0) if rid is None else rid).cast("long").alias("_rid"), F.col(text).cast("binary").alias("_text"))
        found = map_batches(narrow, _doc_lines, "rid long, k1 long, k2 long")
        return found.withColumn("shard", F.pmod(F.col("k1"), F.lit(self.shards)).cast("int"))

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Count the lines of more documents; each row is a document. Starts jobs."""
        return self._changed(docs, text, 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Take documents out again; an error if a line was not inserted so often. Starts jobs."""
        return self._changed(docs, text, -1)

    def _changed(self, docs: DataFrame, text: str, sign: int) -> LineIndex:
        delta = self.lines(docs, text).groupBy("shard", "k1", "k2").agg((F.count("*") * sign).alias("delta"))
        old = self.counts.select("shard", "k1", "k2", "n_docs", F.lit(0).cast("long").alias("delta"))
        rows = old.unionByName(delta.withColumn("n_docs", F.lit(0).cast("long")))
        total = F.sum("n_docs") + F.sum("delta")
        merged = rows.groupBy("shard", "k1", "k2").agg(F.sum("n_docs").alias("before"), total.alias("n_docs"))
        refused = F.raise_error(F.lit("a deleted line was not inserted so often")).cast("long")
        merged = written(merged.withColumn("n_docs", F.when(F.col("n_docs") < 0, refused).otherwise(F.col("n_docs"))), "line-counts")
        was, now = F.col("before") >= self.min_docs, F.col("n_docs") >= self.min_docs
        changed = merged.where(was != now).select("shard", "k1", "k2", now.alias("now"))
        none = F.lit(None)
        kept = self.filters.select("shard", F.lit(0).alias("kind"), none.cast("long").alias("k1"), none.cast("long").alias("k2"), "filter")
        keys = changed.select("shard", F.when(F.col("now"), 2).otherwise(1).alias("kind"), "k1", "k2", none.cast("binary").alias("filter"))
        tasks = min(self.shards, int(merged.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = kept.unionByName(keys).repartition(tasks, "shard").sortWithinPartitions("shard", "kind")
        filters = map_batches(rows, _update_filters, FILTERS)
        counts = merged.where("n_docs > 0").select("shard", "k1", "k2", "n_docs")
        return LineIndex(counts, written(filters, "line-filters"), self.min_docs, self.shards)

    def frequent(self, lines: DataFrame, salts: int = 8) -> DataFrame:
        """Those of the lines (rid, k1, k2, shard) that ``min_docs`` documents or more hold.

        Lines go to their shard, dealt over ``salts`` tasks by document, behind the shard's filter and its
        frequent keys. The filter turns most lines away; the rest are looked up exactly.
        """
        none = F.lit(None)
        salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        filters = self.filters.select("shard", salt.alias("salt"), F.lit(0).alias("kind"), none.cast("long").alias("rid"), none.cast("long").alias("k1"), none.cast("long").alias("k2"), "filter")
        keys = self.counts.where(F.col("n_docs") >= self.min_docs).select("shard", salt.alias("salt"), F.lit(1).alias("kind"), none.cast("long").alias("rid"), "k1", "k2", none.cast("binary").alias("filter"))
        asked = lines.select("shard", F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int").alias("salt"), F.lit(2).alias("kind"), "rid", "k1", "k2", none.cast("binary").alias("filter"))
        tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = filters.unionByName(keys).unionByName(asked).repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "k1", "k2")
        return map_batches(rows, _probe, "rid long, k1 long, k2 long")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard, in order: the filter, the frequent keys, the lines; gives the lines that are frequent."""
    group, cuckoo, keys = None, None, []
    for batch in batches:
        shard, salt, kind, rid, k1, k2 = (batch.column(n).fill_null(0).to_numpy(zero_copy_only=False) for n in ("shard", "salt", "kind", "rid", "k1", "k2"))
        part = shard.astype(np.int64) << 40 | salt.astype(np.int64) << 8 | kind
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if (shard[a], salt[a]) != group:
                group, cuckoo, keys = (shard[a], salt[a]), None, []
            if kind[a] == 0:
                cuckoo = CuckooFilter.from_bytes(batch.column("filter")[a].as_py())
            elif kind[a] == 1:
                keys.append(_pairs(k1[a:b], k2[a:b]))
            elif cuckoo is not None and keys:
                if len(keys) > 1:
                    keys = [np.concatenate(keys)]
                some = a + np.flatnonzero(cuckoo.has(k1[a:b], k2[a:b]))
                place = np.searchsorted(keys[0], pairs := _pairs(k1[some], k2[some]))
                some = some[keys[0][np.minimum(place, len(keys[0]) - 1)] == pairs]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (rid, k1, k2)], names=["rid", "k1", "k2"])


def _pairs(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Keys as complex-free sortable records, in the order of (k1, k2)."""
    out = np.empty(len(k1), [("a", np.int64), ("b", np.int64)])
    out["a"], out["b"] = k1, k2
    return out


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, "_text"):
            n_lines, n_dropped, kept = [], [], []
            drops = part.column("_drop").to_pylist()
            for raw, drop in zip(blobs(part, "_text"), drops, strict=True):
                lines = raw.split(b"\n")
                stay = lines
                if drop:
                    gone = {(d["k1"], d["k2"]) for d in drop}
                    stay = [x for x in lines if not (key := line_key(x)) or _key_hash(key) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(raw if len(stay) == len(lines) else b"\n".join(stay))
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()), part.column("_rest")], names=["_id", "n_lines", "n_dropped", "_kept", "_rest"])


def drop_lines(df: DataFrame, index: LineIndex, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Drop the lines whose keys ``index.min_docs`` or more inserted documents hold.

    Gives the key, the columns of ``keep``, ``n_lines``, ``n_dropped`` and ``kept``, the text of the other lines
    joined by line feeds. Lines are split at line feeds only; a line's key is :func:`line_key`; lines with an
    empty key stay. A document that loses all lines keeps an empty text.

    NULL text: one empty line, kept as the empty text. NULL key: kept. Each row is a document, repeated rows
    too. An empty table gives no rows; other columns are ignored. Only the documents' different line hashes are
    shuffled to the index; the texts are shuffled once, by a hash of the row, to meet their lines.
    """
    keep = keep or []
    rid = row_key(key, text)
    found = index.frequent(index.lines(df, text, rid))
    drops = found.groupBy("rid").agg(F.collect_set(F.struct("k1", "k2")).alias("_drop"))
    docs = df.select(F.col(key).alias("_id"), F.col(text).cast("binary").alias("_text"), F.struct(F.lit(0).alias("_none"), *keep).alias("_rest"), rid.alias("rid"))
    joined = docs.join(drops, "rid", "left").select("_id", "_text", "_rest", "_drop")
    schema = [*fields(joined, _id="_id"), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("_kept", T.BinaryType()), joined.schema["_rest"]]
    out = map_batches(joined, _rebuild, schema)
    return out.select(F.col("_id").alias(key), *[F.col("_rest")[c].alias(c) for c in keep], "n_lines", "n_dropped", F.col("_kept").cast("string").alias("kept"))
