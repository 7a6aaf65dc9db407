"""WARC archives written with an index of their records, and read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.llm.batches import blobs, fields, map_batches, parts
from paceframe.llm.hot_join import join_unique
from paceframe.runtime import scratch_path, written

#: Bytes of an archive file before the next one begins, of a stripe that one task reads, and of one read.
FILE, STRIPE, READ = 1 << 30, 64 << 20, 8 << 20
#: Bytes between two chosen records that are read and thrown away rather than skipped.
GAP = 64 << 10
# The revisit profile of the archive format, and the date given to records without one.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Bare base32 SHA-1 in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, key: str | None, url: str | None, digest: str, size: int, payload: bytes, refers_to: str | None = None, date: str = NO_DATE) -> bytes:
    """One response or revisit record as a gzip member; a revisit has the headers of its response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:x-capture:{_name(key)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-capture:{_name(refers_to)}>"]
    return gzip.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n", 4, mtime=0)


#: What a url keeps as it is in a header; line ends, spaces and characters beyond ASCII are percent-encoded.
_URL_SAFE = "%:/?#[]@!$&'()*+,;=~-._|\\^`{}\"<>"


def _name(key: str | None) -> str:
    """A key as part of a record's name; NULL is the empty name."""
    return "" if key is None else "k" + quote(key, safe="")


def _key(name: str) -> str | None:
    """The key in a record's name."""
    inner = name.removeprefix("<urn:x-capture:").removesuffix(">")
    return unquote(inner[1:]) if inner else None


def parsed(member: bytes) -> dict:
    """A record's fields. The payload of a response must have the digest that its header states."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    named = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = named["WARC-Type"]
    if lines[0] != "WARC/1.1" or kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"record {named.get('WARC-Record-ID')} is damaged")
    return {
        "key": _key(named["WARC-Record-ID"]), "url": named.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": _key(named["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


INDEX = ("file", "offset", "length", "url", "payload_digest", "record_type")


def _write(folder: str, most: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(folder)
        store.create_dir(base)
        out, name, at = None, "", 0
        for batch in batches:
            for part in parts(batch, "_payload"):
                rows = []
                keys, urls, refers, revisits = (part.column(c).to_pylist() for c in ("_key", "_url", "_refers_to", "_revisit"))
                for key, url, refers_to, revisit, payload in zip(keys, urls, refers, revisits, blobs(part, "_payload"), strict=True):
                    if out is None or at >= most:
                        if out is not None:
                            out.close()
                        # A repeated task writes files of its own; only those of the attempt that Spark accepts are in the index.
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    kind, digest = "revisit" if revisit else "response", digest_of(payload)
                    member = record(kind, key, url, digest, len(payload), payload, refers_to)
                    out.write(member)
                    rows.append((name, at, len(member), url, digest, kind))
                    at += len(member)
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *columns], names=["_id", *INDEX])
        if out is not None:
            out.close()

    return work


class Archive:
    """Archive files in ``folder`` and the ``index`` of their records: key, ``file``, ``offset``, ``length``, ``url``, ``payload_digest``,
    ``record_type``. The index is a table beside the files; filter it to choose what :meth:`read` and :meth:`payloads` fetch."""

    def __init__(self, folder: str, index: DataFrame, key: str) -> None:
        self.folder, self.index, self.key = folder, index, key

    @classmethod
    def write(cls, df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", at_least: int = 0, most: int = FILE) -> Archive:
        """Write a record per row into files of about ``most`` bytes below the shared folder.

        Of rows with equal payloads of at least ``at_least`` bytes the one with the largest key becomes a response and the
        others revisit it; smaller payloads are all responses. Rows that tie on payload and largest key are all responses.
        Every record is a gzip member of its own. The payload is the column in UTF-8, NULL the empty one, whole whatever its
        length. A NULL key is less than all others; a NULL url is left out of the record. An empty table gives no files.
        Other columns are ignored.

        Payloads are grouped by digest, narrow and combined before the shuffle; rows are then dealt by digest, those of a
        digest with many rows by key. Tasks write through pyarrow's file systems, so the shared folder must be one that they
        open. Starts jobs.
        """
        spark = df.sparkSession
        folder = scratch_path(spark, "warc")
        raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
        rows = df.select(F.col(key).alias("_id"), F.col(url).cast("string").alias("_url"), raw.alias("_payload")).withColumn("_digest", F.sha1("_payload"))
        same = rows.where(F.octet_length("_payload") >= at_least).groupBy("_digest").agg(F.max("_id").alias("_top"), F.count("*").alias("_n"))
        same = written(same.where("_n > 1"), "warc-copies")
        joined = join_unique(rows, same.withColumn("_copied", F.lit(True)), "_digest", "_n", F.struct("_id", "_url"))
        revisit = F.coalesce(F.col("_copied"), F.lit(False)) & ~F.col("_id").eqNullSafe(F.col("_top"))
        narrow = joined.select("_id", F.col("_id").cast("string").alias("_key"), "_url", F.when(revisit, F.col("_top").cast("string")).alias("_refers_to"), revisit.alias("_revisit"), "_payload")
        kinds = (T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType())
        schema = [*fields(narrow, _id="_id"), *[T.StructField(n, t) for n, t in zip(INDEX, kinds, strict=True)]]
        index = written(map_batches(narrow, _write(folder, most), schema).withColumnRenamed("_id", key), "warc-index")
        return cls(folder, index, key)

    def read(self, chosen: DataFrame | None = None, payload: bool = True) -> DataFrame:
        """The records of the chosen index rows (all, by default): key, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``,
        ``refers_to`` and, if wanted, ``payload`` (NULL in revisits). Urls come back percent-encoded as they are in the archive.

        The ranges are dealt by file and stripe of ``STRIPE`` bytes, about one stripe a task; sorted ranges less than ``GAP`` bytes apart are
        fetched by one read of about ``READ`` bytes. Every payload is checked against its digest. Starts a job for the
        number of tasks.
        """
        index = self.index if chosen is None else chosen
        wanted = index.select("file", "offset", "length")
        tasks = max(-(-(wanted.agg(F.sum("length")).first()[0] or 0) // STRIPE), index.sparkSession.sparkContext.defaultParallelism)
        dealt = wanted.withColumn("_stripe", F.floor(F.col("offset") / STRIPE)).repartition(int(tasks), "file", "_stripe").sortWithinPartitions("file", "offset")
        kinds = {"key": T.StringType(), "url": T.StringType(), "payload_bytes": T.LongType(), "payload_digest": T.StringType(), "record_type": T.StringType(), "refers_to": T.StringType(), "payload": T.BinaryType()}
        if not payload:
            del kinds["payload"]
        found = map_batches(dealt.select("file", "offset", "length"), _read(self.folder, payload), [T.StructField(n, t) for n, t in kinds.items()])
        own = self.index.schema[self.key].dataType
        rest = [c for c in kinds if c not in ("key", "refers_to")]
        return found.select(F.col("key").cast(own).alias(self.key), *rest, F.col("refers_to").cast(own).alias("refers_to"))

    def payloads(self, chosen: DataFrame) -> DataFrame:
        """(key, ``url``, ``payload_digest``, ``payload``) of the chosen index rows; a revisit has its response's payload. Starts jobs."""
        wanted = written(chosen.groupBy("payload_digest").agg(F.count("*").alias("_n")), "warc-wanted")
        responses = self.index.where("record_type = 'response'").join(wanted.select("payload_digest"), "payload_digest", "left_semi")
        texts = self.read(responses.dropDuplicates(["payload_digest"])).select("payload_digest", "payload")
        texts = written(texts.join(wanted, "payload_digest"), "warc-payloads")
        rows = chosen.select(self.key, "url", "payload_digest")
        return join_unique(rows, texts, "payload_digest", "_n", F.struct(self.key, "url"))


def _read(folder: str, payload: bool) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(folder)
        names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else [])]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        open_name, source = None, None

        def fetched(name: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal open_name, source
            if name != open_name:
                if source is not None:
                    source.close()
                open_name, source = name, store.open_input_file(f"{base}/{name}")
            start, end = ranges[0][0], max(a + n for a, n in ranges)
            data = memoryview(source.read_at(end - start, start))
            rows = [parsed(bytes(data[a - start : a - start + n])) for a, n in ranges]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds, strict=False)], names=names)

        name, ranges, end = None, [], 0
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if ranges and (file != name or offset - end > GAP or offset + length - ranges[0][0] > READ):
                    yield fetched(name, ranges)
                    ranges = []
                name, end = file, max(offset + length, end if ranges else 0)
                ranges.append((offset, length))
        if ranges:
            yield fetched(name, ranges)
        if source is not None:
            source.close()

    return work
