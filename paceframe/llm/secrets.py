"""Secret scans over a trigram inverted index: Boolean trigram queries choose the texts that a rule reads."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as ops
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.llm.batches import fields, map_batches, parts

#: Literal sets larger than these count as unknown.
MOST_STRINGS, MOST_CLASS = 64, 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches whose ``group`` has fewer than ``least`` characters are dropped.

    Patterns are read with ASCII classes and ASCII case folding. Matches are leftmost and do not overlap.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# The patterns of the base kinds. Runs of 32 hexadecimal digits or more are found at a run's first digit.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 32),
)
# Public formats of tokens and keys.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
)


# A query is ANY (all texts), a trigram's code, or ("and" | "or", queries).
ANY = ("and", ())


def _join(kind: str, queries: list) -> tuple | int:
    queries = list(dict.fromkeys(queries))
    if kind == "or" and ANY in queries:
        return ANY
    queries = [q for q in queries if q != ANY]
    return queries[0] if len(queries) == 1 else (kind, tuple(queries))


def _of_strings(strings: set[str]) -> tuple | int:
    """Texts that hold one of the strings."""
    found = []
    for s in strings:
        raw = s.encode().lower()
        found.append(_join("and", [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]))
    return _join("or", found)


def _explain(tree) -> tuple[set[str] | None, tuple | int]:
    """Of a parsed pattern: the strings it can match, if few, and the query that every match satisfies."""
    exact: set[str] | None = {""}
    known: list = []
    run = {""}
    for op, value in tree:
        strings, query = _node(op, value)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            exact = None if exact is None else run
        else:
            known += [_of_strings(run), query]
            exact, run = None, strings if strings is not None else {""}
    known.append(_of_strings(run))
    return exact, _join("and", known)


def _node(op, value) -> tuple[set[str] | None, tuple | int]:
    if op is ops.LITERAL:
        return {chr(value)}, ANY
    if op is ops.IN:
        if all(kind is ops.LITERAL for kind, _ in value) and len(value) <= MOST_CLASS:
            return {chr(x) for _, x in value}, ANY
        return None, ANY
    if op is ops.SUBPATTERN:
        exact, query = _explain(value[3])
        return exact, (query if exact is None else ANY)
    if op is ops.BRANCH:
        sides = [_explain(x) for x in value[1]]
        if all(exact is not None for exact, _ in sides) and sum(len(e) for e, _ in sides) <= MOST_STRINGS:
            return set().union(*[e for e, _ in sides]), ANY
        return None, _join("or", [q if e is None else _of_strings(e) for e, q in sides])
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        least, most, inner = value
        exact, query = _explain(inner)
        if exact is not None and (least, most) == (0, 1):
            return exact | {""}, ANY
        if exact is not None and least == most and len(exact) == 1:
            return {next(iter(exact)) * least}, ANY
        return None, ((query if exact is None else _of_strings(exact)) if least else ANY)
    if op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
        return {""}, ANY
    return None, ANY


def trigram_query(rule: Rule) -> tuple | int:
    """The Boolean trigram query of a rule over ASCII-lower-cased UTF-8; ``ANY`` if no trigram is mandatory."""
    exact, query = _explain(_parser.parse(rule.pattern, re.ASCII))
    return query if exact is None else _of_strings(exact)


def _codes(query) -> set[int]:
    return {query} if isinstance(query, int) else set().union(*map(_codes, query[1])) if query[1] else set()


class TrigramIndex:
    """Postings of the wanted trigrams over one block of texts."""

    def __init__(self, column: pa.Array, wanted: np.ndarray) -> None:
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        self.rows = np.arange(len(column))
        lower = raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32))
        wide = lower.astype(np.uint32)
        codes = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        place = np.flatnonzero(wanted[codes])
        row = np.searchsorted(at, place, "right") - 1
        whole = place + 3 <= at[row + 1]
        pairs = np.unique(codes[place[whole]].astype(np.int64) << 32 | row[whole])
        code, row = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(code, prepend=-1))
        self.postings = {int(code[a]): row[a:b] for a, b in zip(cuts, [*cuts[1:], len(code)], strict=True)}

    def texts(self, query) -> np.ndarray:
        """Rows that satisfy a query."""
        if isinstance(query, int):
            return self.postings.get(query, self.rows[:0])
        kind, queries = query
        found = self.rows if kind == "and" else self.rows[:0]
        for one in map(self.texts, queries):
            found = np.intersect1d(found, one, True) if kind == "and" else np.union1d(found, one)
        return found


def _scan(rules: tuple[Rule, ...]):
    queries = [trigram_query(r) for r in rules]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [r.compiled() for r in rules]
        wanted = np.zeros(1 << 24, bool)
        wanted[sorted(set().union(*map(_codes, queries)))] = True
        for batch in batches:
            for part in parts(batch, "_text"):
                column = part.column("_text").cast(pa.large_binary()).fill_null(b"")
                index = TrigramIndex(column, wanted)
                spans: list[list[tuple]] = [[] for _ in range(len(column))]
                texts: dict[int, str] = {}
                for order, (rule, pattern, query) in enumerate(zip(rules, patterns, queries, strict=True)):
                    for row in index.texts(query).tolist():
                        if row not in texts:
                            texts[row] = column[row].as_py().decode("utf-8", "replace")
                        for m in pattern.finditer(texts[row]):
                            if len(m[rule.group]) >= rule.least:
                                spans[row].append((m.start(), order, m.end()))
                found = [[{"kind": rules[o].kind, "start": a, "end": b} for a, o, b in sorted(x)] for x in spans]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(found, SPANS)], names=["_id", "spans"])

    return work


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secrets(df: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of secrets in whole texts: key and ``spans``, an array of (kind, start, end) by start, then rule order.

    Places are code points, the end exclusive. Each block of about 2 MB of text gets an inverted index of
    the trigrams that the rules' queries name; a rule reads the texts that satisfy its query, or all of
    them if it has no mandatory trigram. No shuffle; a task holds one block at a time.

    NULL and empty texts have no spans. Repeated rows give repeated results; an empty table gives no
    rows; other columns are ignored.
    """
    narrow = df.select(F.col(key).alias("_id"), F.col(text).cast("binary").alias("_text"))
    spans = T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    return map_batches(narrow, _scan(tuple(rules)), [*fields(narrow, _id="_id"), spans]).withColumnRenamed("_id", key)
