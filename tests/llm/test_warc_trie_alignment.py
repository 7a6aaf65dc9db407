"""Archives, conversation tries and tokenizer alignment against brute force."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate
from pathlib import Path

import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paceframe.llm import alignment, hot_join, prefix_trie, queries, warc
from paceframe.llm.prefix_trie import PrefixTrie

LONG = "x" * 30000 + "\n" + "long Wörter " * 9000


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# -- archives


def pages_of(spark, rows):
    """Pages with more columns, whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "f", 7, "d") for r in rows], "page_id long, url string, html string, file string, offset int, _digest string").repartition(3)


def expected_records(rows, at_least):
    top = {}
    for page, _, html in rows:
        if page is not None:
            top[html or ""] = max(page, top.get(html or "", page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        best = top.get(html or "")
        revisit = len(raw) >= at_least and page != best
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=repr)


def page_rows():
    rng = random.Random(5)
    payloads = [None, "", "a", "ä" * 50, "<p>\r\n\r\nWARC/1.1\r\n</p>", LONG]
    rows = [(i, rng.choice([None, "", "http://x.y/ä b\r\nWARC-Type: response", f"http://h/{i}"]), rng.choice([*payloads, f"<html>{i}</html>"])) for i in range(300)]
    rows += [(1000 + i, f"http://copy/{i}", "<html>copy</html>") for i in range(200)]  # one payload on a large share of the rows
    return rows + [(None, "http://n", "only without a key"), (None, None, "a"), (1500, "u", "tie"), (1500, "v", "tie"), (1400, "w", "tie")]


@pytest.mark.parametrize("at_least", [0, 20])
def test_archive_round_trip(spark, at_least):
    rows = page_rows()
    archive = warc.Archive.write(pages_of(spark, rows), at_least=at_least, most=20_000)
    found = archive.read()
    assert got(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected_records(rows, at_least)
    html = defaultdict(set)
    for page, _, text in rows:
        html[page].add((text or "").encode())
    assert all(bytes(r["payload"]) in html[r["page_id"]] for r in found.where("record_type = 'response'").collect())
    restored = archive.payloads(archive.index.where("page_id % 3 = 0"))
    assert got(restored.select("page_id", F.col("payload").cast("string"))) == sorted(((p, h or "") for p, _, h in rows if p is not None and p % 3 == 0), key=repr)


def test_archive_files_are_plain_members_at_the_indexed_places(spark):
    archive = warc.Archive.write(pages_of(spark, page_rows()), most=5_000)
    index = archive.index.toPandas()
    assert index["file"].nunique() > 3
    folder = Path(archive.folder)
    for name, records in index.groupby("file"):
        raw = (folder / name).read_bytes()
        assert records["length"].sum() == len(raw)
        for r in records.itertuples():
            member = gzip.decompress(raw[r.offset : r.offset + r.length])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
        assert gzip.decompress(raw).count(b"WARC-Record-ID: ") == len(records)


def test_chosen_records_are_read_by_few_ranges(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", "y" * 2000 + str(random.Random(i).random())) for i in range(400)]
    archive = warc.Archive.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    chosen = archive.index.where("page_id % 7 = 0")
    assert got(archive.read(chosen, payload=False), "page_id") == [(i,) for i in sorted(range(0, 400, 7), key=lambda i: repr((i,)))]
    assert archive.read(archive.index.limit(0)).count() == 0
    empty = warc.Archive.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.read().count() == 0


def test_damaged_record_is_an_error():
    member = warc.record("response", "1", "http://a", warc.digest_of(b"other"), 5, b"hello")
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(member)
    good = warc.parsed(warc.record("revisit", "1", None, warc.digest_of(b"hello"), 5, b"hello", "a b>"))
    assert (good["key"], good["url"], good["payload"], good["refers_to"], good["payload_bytes"]) == ("1", None, None, "a b>", 5)


def test_join_with_hot_keys_keeps_every_row(spark, monkeypatch):
    rows = [(f"k{i % 50}" if i % 3 else "hot", i) for i in range(900)] + [(None, 900), ("alone", 901)]
    left = spark.createDataFrame(rows, "k string, v long")
    right = left.where("k <> 'alone'").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    monkeypatch.setattr(hot_join, "HOT", 10)
    best = {}
    for k, v in rows:
        best[k] = max(v, best.get(k, v))
    found = hot_join.join_unique(left, right, "k", "n", F.col("v"))
    assert got(found) == sorted(((k, v, None if k in (None, "alone") else best[k]) for k, v in rows), key=repr)


# -- conversations


def slow_trie(conversations):
    """Uncompacted trie of {id: [(role, text)]}."""
    if not conversations:
        return []
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        gain = 0
        if p:
            words = [w for w in p[-1][1].translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
            gain = (len(m) - 1) * len(words)
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += gain
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
            for p, m in members.items()
        ),
        key=repr,
    )


def rebuilt(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = conversations.get(c - c % 20, [])[:h] + turns[h:]
    return out


def conversation_rows(seed, n, long=70):
    rng = random.Random(seed)
    texts = [None, "", "a b", "a\x0bb  c\n", "ü\xa0v w", "one", "two words"]
    out = []
    for c in rng.sample(range(300), n):
        size = rng.choice([1, 1, 2, 3, 5, rng.randint(1, long)])
        out += [(c, None if t == 0 and c % 7 == 0 else t * 3, rng.choice(["u", None]), rng.choice(texts[: rng.choice([2, 7])])) for t in range(size)]
    return out


def turns_of(rows):
    conversations = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        conversations[c].append((role or "", text or ""))
    return dict(conversations)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, n int").repartition(3)


def test_trie_equals_brute_force(spark):
    rows = conversation_rows(1, 120)
    # one beginning that many share, beyond a slab; copies; conversations that are the beginning of others
    shared = [("u", f"turn {i % 5}") for i in range(75)]
    more = {500 + i: shared[: 40 + i % 36] + [("u", f"tail {i % 3}")] * (i % 4) for i in range(60)}
    rows += [(c, i, role, text) for c, turns in more.items() for i, (role, text) in enumerate(turns)]
    turns, lengths = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(table_of(spark, [*rows, (None, 1, "u", "no id")])))
    trie = PrefixTrie.empty(spark).insert(turns, lengths)
    found = trie.expanded()
    assert sorted(found.columns) == sorted(COLUMNS)
    assert got(found, *COLUMNS) == slow_trie(rebuilt(turns_of(rows)))


def test_trie_grown_in_batches_equals_one_batch(spark):
    rows = conversation_rows(2, 90, long=140)
    rows += [(1000 + i, 0, "u", "hot first turn") for i in range(40)]
    first, second = [r for r in rows if r[0] % 2], [r for r in rows if not r[0] % 2]
    trie = PrefixTrie.empty(spark)
    for batch in (first, second):
        trie = trie.insert(prefix_trie.ordered_turns(table_of(spark, batch)))
    assert got(trie.expanded(), *COLUMNS) == slow_trie(turns_of(rows))


def test_trie_of_very_long_conversations(spark):
    """Over SLAB * SLAB turns, so that slabs are named in two levels."""
    turns = [("u", str(i % 11)) for i in range(1100)]
    conversations = {1: turns, 2: turns[:1050], 3: [*turns[:1040], ("u", "other")], 4: turns[:1024], 5: turns[:32], 6: [("v", "")], 7: turns}
    rows = [(c, i, r, t) for c, ts in conversations.items() for i, (r, t) in enumerate(ts)]
    assert got(PrefixTrie.empty(spark).insert(prefix_trie.ordered_turns(table_of(spark, rows))).expanded(), *COLUMNS) == slow_trie(conversations)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = prefix_trie.ordered_turns(table_of(spark, []))
    turns, lengths = prefix_trie.with_shared_heads(empty)
    assert PrefixTrie.empty(spark).insert(turns, lengths).expanded().count() == 0
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    turns, lengths = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(table_of(spark, [(lone, 0, "u", "gone")])))
    assert got(PrefixTrie.empty(spark).insert(turns, lengths).expanded(), *COLUMNS) == slow_trie({lone: []})


def test_fattest(spark):
    cases = [(a, b) for a in range(prefix_trie.SLAB) for b in range(a + 1, prefix_trie.SLAB + 1)]
    df = spark.createDataFrame(cases, "a int, b int").selectExpr("a", "b", f"{prefix_trie.fattest('a', 'b')} AS f")
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: (x & -x, x)) for r in df.collect())


def test_handles_lie_on_their_edges_and_are_unique(spark):
    trie = PrefixTrie.empty(spark).insert(prefix_trie.ordered_turns(table_of(spark, conversation_rows(3, 80))))
    nodes = trie.nodes.toPandas()
    assert nodes["handle"].is_unique and nodes["name"].is_unique and nodes["id"].is_unique
    for r in nodes.itertuples():
        f = max(range(r.low + 1, r.depth + 1), key=lambda x: (x & -x, x))
        assert r.path[f - 1] == r.handle and r.path[r.low] == r.name and r.path[-1] == r.id and len(r.path) == r.depth


# -- tokenizers

BYTES, PIECES = (public_tokenizers.path(x) for x in (queries.BYTE_VOCABULARY, queries.PIECE_VOCABULARY))


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(BYTES, PIECES)


def slow_alignment(own, text):
    """Both tokenizers over the whole text at once, byte ends from decoded bytes."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = own.first.encode(" " + text, add_special_tokens=False).ids, own.second.encode(text)
    sides = [own.first_bytes[i] for i in a], [own.second_bytes[i] for i in b]
    if any(b"".join(s) != raw for s in sides):
        return None
    ends = [{e: i for i, e in enumerate(accumulate(map(len, s)))} for s in sides]
    groups, links, i, j = [], [], 0, 0
    for end in sorted(ends[0].keys() & ends[1].keys()):
        ni, nj = ends[0][end] + 1, ends[1][end] + 1
        groups.append(",".join(map(str, a[i:ni])) + "|" + ",".join(map(str, b[j:nj])))
        links.append((a[ni - 1], b[nj - 1]))
        i, j = ni, nj
    return len(a), len(b), groups, links


def odd_texts(n, seed):
    rng = random.Random(seed)
    letters = [*"ab cdeéß日本語😀 \n\t  '.,12<|>", "<|endoftext|>", "<s>", "<0x41>", "\xa0", "　", "\x1c", "​", "\x00", "'s", "𐍈", " ", " the", " of", "ǆ", "́"]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(n)]
    return [None, "", " ", "\n", "  two", "a", "a▁b", "▁", "<|endoftext|>", "日本", *texts, LONG, *["the same text again"] * 30]


def test_chunks_give_the_whole_text_s_alignment(aligner):
    texts = [t for t in odd_texts(1500, 1) if t is not None]
    for text, entry in zip(texts, aligner([t.encode() for t in texts]), strict=True):
        slow = slow_alignment(aligner, text)
        assert (entry is None) == (slow is None)
        if slow:
            assert entry[:4] == (slow[0], slow[1], len(slow[2]), ";".join(slow[2]))
            assert entry[4] == b"".join((a << 32 | b).to_bytes(8, "little") for a, b in slow[3])
    assert aligner([b"\xff\xfe"[:0]]) == [None]


@pytest.mark.parametrize("head", [alignment.HEAD, 1, 20])
def test_alignment_equals_brute_force(spark, aligner, monkeypatch, head, tmp_path):
    monkeypatch.setattr(alignment, "HEAD", head)
    texts = odd_texts(150, 2)
    rows = [(i % 170, t, "g", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, groups string, n_a int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    slow = [slow_alignment(aligner, t) for t in texts]
    counts = Counter(pair for s in slow if s for pair in s[3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    expected = []
    for (i, *_), s in zip(rows, slow, strict=True):
        a, b, groups, links = s or (0, 0, [], [])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if s else ""
        expected.append((i, a, b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    found = queries.op13_alignment(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(found) == sorted(expected, key=repr)
    pairs = alignment.pair_counts(alignment.groups(spark.read.parquet(f"{tmp_path}/documents.parquet"), BYTES, PIECES))
    assert got(pairs, "a", "b", "n") == sorted(((a, b, n) for (a, b), n in counts.items()), key=repr)


def test_alignment_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.with_counts(alignment.groups(empty, BYTES, PIECES)).count() == 0


def test_byte_ends_are_refined_where_spans_are_not_sure():
    import numpy as np

    spans, sure = np.array([1, 4, 4, 4, 5]), np.array([True, False, False, True, True])
    assert alignment.byte_ends(spans, sure, np.array([1, 1, 1, 1, 1])).tolist() == [1, 2, 3, 4, 5]


def test_symbols_cover_all_bytes():
    table = alignment.byte_of_symbol()
    assert sorted(table.values()) == list(range(256)) and table["Ġ"] == 32 and table["Ċ"] == 10


def test_queries_of_pages_and_conversations_equal_brute_force(spark, sf):
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    rows = list(pages[["page_id", "url", "html"]].itertuples(index=False, name=None))
    assert got(queries.op11_warc(spark, sf)) == expected_records(rows, 0)
    turns = pd.read_parquet(f"{sf}/conversations.parquet")
    rows = list(turns[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    assert got(queries.op12_prefix_trie(spark, sf), *COLUMNS) == slow_trie(rebuilt(turns_of(rows)))
