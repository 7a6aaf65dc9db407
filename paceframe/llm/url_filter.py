"""URL rules by a sort-merge range join: a rule is an interval of reversed-host keys, swept in order."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.llm.batches import checkpointed, fields, map_batches

#: Kinds of events in the sweep, in the order they take at one key.
CARRIED, RULE, PAGE = 0, 1, 2


@dataclass(frozen=True)
class Rule:
    """A host, a path its urls start with, and ``allow`` or ``block``."""

    host: str
    path: str
    verdict: str


def ascii_lower(column: Column) -> Column:
    """A-Z as a-z, all else kept."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) up to ``/``, ``?``, ``#`` or the end, and the path up to ``?``, ``#`` or the end.

    A url that is NULL or holds no ``://`` has an empty host and an empty path.
    """
    place = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(place > 0, F.substr(url, place + 3)).otherwise("")
    whole = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.substring_index(whole, "/", 1)
    return ascii_lower(host), F.substr(whole, F.char_length(host) + 1)


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each ended by a dot: a host's key starts with the keys of all its parents."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as a table (host, path, verdict)."""
    return spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")


def _fit(stack: list[tuple[str, list]], path: str) -> tuple[str, str] | None:
    """The longest rule on the stack whose path starts ``path``; its text and verdict."""
    best: tuple | None = None
    for _, rules in stack:
        for size, start, text, verdict in reversed(rules):
            if best and size < best[0]:
                break
            if path.startswith(start) and (best is None or (size, verdict, text) > best[:3]):
                best = (size, verdict, text)
    return (best[2], best[1]) if best else None


def _sweep(default: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list]] = []
        split = None
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("_split", "_key", "_kind", "_path", "_rule", "_verdict")}
            found, kept = [], []
            for at, (part, key, kind, path, rule, verdict) in enumerate(zip(*columns.values(), strict=True)):
                if part != split:
                    split, stack = part, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == PAGE:
                    kept.append(at)
                    found.append(_fit(stack, path) or (None, default))
                else:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    insort(stack[-1][1], (len(rule), path, rule, verdict))
            if kept:
                pages = batch.take(pa.array(kept))
                out = [pages.column("_id"), pages.column("_host"), pages.column("_path")]
                out += [pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["_id", "_host", "_path", "_rule", "_verdict"])

    return work


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """The rule and verdict of every url: key, ``host``, ``path``, ``rule``, ``verdict``.

    A rule (host, path, verdict) fits its host and all subdomains when the url's path starts with the
    rule's path; the rule of the empty host fits every host. The longest rule (as the text host + path)
    wins; of equally long ones ``block`` wins, then the later text. No rule: ``rule`` NULL and the default verdict.

    The rules' hosts are intervals of reversed-host keys. Rules and urls are sorted together by range
    of (key, kind, path, row), so a hot host spreads over many tasks; a sweep holds the stack of rules
    whose intervals are open. The intervals open at a task's first key are found by an equality join of
    that key's parents with the rules and sent in front of its rows.

    NULL url: empty host and path, judged like others. Repeated rows give repeated results. Empty tables
    give no rows or the default verdict. Rules with a NULL part are ignored; extra columns are ignored.
    Starts a job.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    none = F.lit(None).cast("string")
    urls = pages.select(
        F.col(key).alias("_id"), host.alias("_host"), path.alias("_path"), none.alias("_rule"), none.alias("_verdict"),
        F.lit(PAGE).alias("_kind"), F.monotonically_increasing_id().alias("_row"),
    ).withColumn("_key", host_key(F.col("_host")))
    known = rules.dropna(subset=["host", "path", "verdict"]).select(ascii_lower(F.col("host")).alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict")).distinct()
    opening = known.select(
        F.lit(None).cast(urls.schema["_id"].dataType).alias("_id"), "_host", "_path",
        F.concat("_host", "_path").alias("_rule"), "_verdict", F.lit(RULE).alias("_kind"), F.lit(-1).cast("long").alias("_row"),
        F.when(F.col("_host") == "", F.lit("")).otherwise(host_key(F.col("_host"))).alias("_key"),
    )
    order = ["_key", "_kind", "_path", "_row"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(urls.unionByName(opening).repartitionByRange(tasks, *order).withColumn("_split", F.spark_partition_id()))

    # The rules open at a split's first key: those of that key's parents that come before the split.
    first = ranged.groupBy("_split").agg(F.min(F.struct("_key", "_kind", "_path", "_row")).alias("_first"))
    labels = F.split(F.expr("substring(_first._key, 1, char_length(_first._key) - 1)"), r"\.")
    parents = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit("."))))
    opened = F.struct(*order) < F.col("_first")
    carried = first.withColumn("_key", F.explode(parents)).join(opening, "_key").where(opened).withColumn("_kind", F.lit(CARRIED))
    sorted_rows = (
        ranged.unionByName(carried.select(*ranged.columns))
        .repartition(tasks, "_split")
        .sortWithinPartitions("_split", F.col("_kind") != CARRIED, "_key", "_kind", "_path", "_row")
    )
    text = [T.StructField(n, T.StringType()) for n in ("_host", "_path", "_rule", "_verdict")]
    out = map_batches(sorted_rows, _sweep(default), fields(urls, _id="_id") + text)
    return out.select(F.col("_id").alias(key), *[F.col(f"_{n}").alias(n) for n in ("host", "path", "rule", "verdict")])
