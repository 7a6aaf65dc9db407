"""Operators on training data against brute force on small fixtures, with NULLs, empty texts, ties and repeats."""

import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from paceframe.llm import components, decontaminate, lattice, line_dedup, nearest, packing, secrets, sharding, simhash, toxicity, url_filter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def docs_of(spark, texts, ids=None):
    """A document table with an extra column whose names clash with those used inside."""
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, "x", 7, "rest") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, _row int, shard string").repartition(3)


ODD = [None, "", " \n\t", "one", "Ünï çödé \n one \n", "one", "x" * 30000 + "\n" + "long " * 9000]


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# -- url rules


def judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        for end in "?#":
            rest = rest.split(end, 1)[0]
        host, slash, path = rest.partition("/")
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = slash + path
    fits = [r for r in rules if (r.host == "" or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), r.verdict, r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_url_rules_equal_a_scan_of_all_rules(spark):
    rng = random.Random(3)
    labels = ["a", "b", "com", "net", "", "x-y", "é"]
    hosts = [".".join(rng.choices(labels, k=rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/é"]
    rules = [url_filter.Rule(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(40)] + [url_filter.Rule("", "/a/b", "block")]
    urls = [None, "", "no scheme", "http://", "http://A.COM", "x://y://z/a", "http://a.com?/a", "http://a.com#/a/"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#f', 'tail'])}" for _ in range(700)]
    urls += ["http://a.b.com/a/b"] * 500
    pages = spark.createDataFrame([(i % 900, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(4)
    found = url_filter.judged(pages, url_filter.rules_table(spark, rules))
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert got(found) == sorted(((i % 900, *judge(u, rules)) for i, u in enumerate(urls)), key=repr)
    assert url_filter.judged(pages.limit(0), url_filter.rules_table(spark, rules)).count() == 0
    assert {r["verdict"] for r in url_filter.judged(pages, url_filter.rules_table(spark, []), default="block").collect()} == {"block"}


# -- line dedup


def kept_lines(texts, min_docs):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for t in texts]
    seen = Counter(k for ks in keys for k in set(ks) if k)
    return [(len(ks), sum(seen[k] >= min_docs for k in ks if k), "\n".join(x for x, k in zip((t or "").split("\n"), ks, strict=True) if not k or seen[k] < min_docs)) for t, ks in zip(texts, keys, strict=True)]


def line_texts(n, seed):
    rng = random.Random(seed)
    return [*ODD, *["\n".join(rng.choice([w, w.upper(), f" {w}\t", "", f"{w} {rng.random()}"]) for w in rng.choices(WORDS, k=rng.randint(0, 12))) for _ in range(n)]]


def test_lines_equal_brute_force_and_deletion_goes_back(spark):
    first, more = line_texts(80, 1), line_texts(60, 2)
    one, two = docs_of(spark, first), docs_of(spark, more)
    empty = line_dedup.LineIndex.empty(spark, 10, 5)
    index = empty.insert(one)
    assert got(line_dedup.drop_lines(one, index), "doc_id", "n_lines", "n_dropped", "kept") == sorted(((i, *x) for i, x in enumerate(kept_lines(first, 10))), key=repr)
    both = index.insert(two)
    whole = [*first, *more]
    assert got(line_dedup.drop_lines(docs_of(spark, whole), both), "doc_id", "n_lines", "n_dropped", "kept") == sorted(((i, *x) for i, x in enumerate(kept_lines(whole, 10))), key=repr)
    back = both.delete(two)
    assert got(back.counts) == got(index.counts)
    assert got(line_dedup.drop_lines(one, back)) == got(line_dedup.drop_lines(one, index))
    assert back.delete(one).counts.count() == 0
    with pytest.raises(Exception, match="not inserted"):
        index.delete(two)


def test_lines_of_empty_tables_null_and_repeated_ids(spark):
    docs = docs_of(spark, ["a\nb"] * 12, [None] * 6 + [3] * 6)
    index = line_dedup.LineIndex.empty(spark, 10, 3).insert(docs)
    out = line_dedup.drop_lines(docs, index, keep=["shard", "_row"])
    assert out.columns == ["doc_id", "shard", "_row", "n_lines", "n_dropped", "kept"]
    assert [(r["n_lines"], r["n_dropped"], r["kept"], r["shard"]) for r in out.collect()] == [(2, 2, "", "rest")] * 12
    assert line_dedup.drop_lines(docs.limit(0), index).count() == 0
    assert line_dedup.drop_lines(docs, line_dedup.LineIndex.empty(spark, 10, 3)).agg(F.sum("n_dropped")).first()[0] == 0


def test_cuckoo_filter_adds_and_removes():
    rng = np.random.default_rng(5)
    k1, k2 = rng.integers(-(2**62), 2**62, (2, 3000))
    cuckoo = line_dedup.CuckooFilter()
    cuckoo.add(k1[:2000], k2[:2000])
    assert len(cuckoo.tables) > 1 and cuckoo.has(k1[:2000], k2[:2000]).all()
    assert cuckoo.has(k1[2000:], k2[2000:]).mean() < 0.02
    again = line_dedup.CuckooFilter.from_bytes(cuckoo.to_bytes())
    again.remove(k1[:1500], k2[:1500])
    assert again.has(k1[1500:2000], k2[1500:2000]).all() and again.has(k1[:1500], k2[:1500]).mean() < 0.02
    with pytest.raises(KeyError):
        again.remove(k1[:1500], k2[:1500])


def test_cuckoo_filter_of_many_keys_is_one_table_and_grows_by_doubling():
    rng = np.random.default_rng(6)
    k1, k2 = rng.integers(-(2**62), 2**62, (2, 200_000))
    cuckoo = line_dedup.CuckooFilter([])
    cuckoo.add(k1[:50_000], k2[:50_000])
    assert len(cuckoo.tables) == 1
    for at in range(50_000, 200_000, 10_000):
        cuckoo.add(k1[at : at + 10_000], k2[at : at + 10_000])
    sizes = [len(t) for t in cuckoo.tables]
    assert all(b >= 2 * a for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) * 4 < 8 * 200_000
    assert cuckoo.has(k1, k2).all()
    cuckoo.remove(k1[1000:150_000], k2[1000:150_000])
    kept = np.r_[:1000, 150_000:200_000]
    assert cuckoo.has(k1[kept], k2[kept]).all() and cuckoo.has(k1[1000:150_000], k2[1000:150_000]).mean() < 0.02
    cuckoo.remove(k1[kept], k2[kept])
    assert sum(np.count_nonzero(t) for t in cuckoo.tables) == 0


def test_cuckoo_filter_holds_more_keys_of_one_mark_than_its_buckets():
    k1, k2 = (np.arange(1, 41) << 40) + 5, np.full(40, 77)  # one mark, one pair of buckets
    cuckoo = line_dedup.CuckooFilter()
    cuckoo.add(k1, k2)
    assert sum(np.count_nonzero(t) for t in cuckoo.tables) == 40
    cuckoo.remove(k1[:39], k2[:39])
    assert cuckoo.has(k1[39:], k2[39:]).all() and sum(np.count_nonzero(t) for t in cuckoo.tables) == 1
    cuckoo.remove(k1[39:], k2[39:])
    assert not cuckoo.has(k1, k2).any()


def test_line_query_counts_rows_with_one_id_as_the_sql_does(spark, tmp_path):
    import duckdb

    from paceframe.llm import queries

    docs = docs_of(spark, ["shared\none", "shared\nown", None, "shared"] * 3, [1, 1, 2, None] * 3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(queries.SQL["op2_line_dedup"])
    columns = [d[0] for d in con.description]
    found = queries.op2_line_dedup(spark, str(tmp_path))
    assert sorted(map(repr, con.fetchall())) == sorted(repr(tuple(r)) for r in found.select(*columns).collect())
    assert found.count() == 12 and found.agg(F.max("n_dropped")).first()[0] == 0
    docs.unionAll(docs).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    con.execute(queries.SQL["op2_line_dedup"])
    assert sorted(map(repr, con.fetchall())) == sorted(repr(tuple(r)) for r in queries.op2_line_dedup(spark, str(tmp_path)).select(*columns).collect())
    assert queries.op2_line_dedup(spark, str(tmp_path)).agg(F.sum("n_dropped")).first()[0] == 18


# -- decontamination


def test_leaks_equal_a_scan_of_all_alignments(spark):
    rng = random.Random(9)
    # three words give repeated tokens: many hits, many alignments, ties
    texts = [" ".join(rng.choices("abc" if i % 2 else "ab", k=rng.randint(0, 90))) for i in range(60)] + ["a " * 3000, "a b " * 1500]
    items = [" ".join(rng.choices("abc", k=rng.randint(5, 40))) for _ in range(8)] + ["a " * 300, "b " * 20, "a b " * 9]
    expected = []
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            t, own, best = np.array(text.split()), np.array(item.split()), None
            for shift in range(-len(own), len(t)):
                a, b = max(0, -shift), min(len(own), len(t) - shift)
                if b <= a:
                    continue
                same = own[a:b] == t[a + shift : b + shift]
                found = decontaminate.overlap(same, 13, 0.8) if len(own) >= 13 else (0, len(own)) if b - a == len(own) and same.all() else None
                if found and (best is None or found[1] - found[0] > best[2]):
                    best = (a + found[0] + shift, a + found[0], found[1] - found[0], int(same[slice(*found)].sum()))
            if best:
                expected.append((d, i, best[0], best[0] + best[2], best[1], best[3], len(own)))
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id int, text string")
    found = decontaminate.leaks(docs_of(spark, texts), benchmark)
    assert got(found, "doc_id", "item_id", "start", "end", "item_start", "n_same", "item_tokens") == sorted(expected, key=repr) and len(expected) > 40


def test_hits_are_expanded_in_slices_and_may_be_none(spark, monkeypatch):
    def aligned():
        batch = decontaminate.Tokenizer()(pa.array([b"a " * 50, b"", b"b a b"], pa.binary()))
        items = decontaminate.Items.of([1, 2], [b"a " * 9, b"b"])
        found = decontaminate.Diagonals(batch, items)
        none = np.zeros(0, np.int64)
        found.add_hits(none, none, none, none)
        assert list(found.each()) == []
        place = np.arange(40)
        found.add_hits(place, place * 0, place % 3, place % 3 + 2)
        expected = {(int(items.item[k]), p - int(items.place[k])) for p in range(40) for k in (p % 3, p % 3 + 1)}
        assert [(r, i, x) for r, i, shifts in found.each() for x in shifts] == sorted((0, *e) for e in expected)
        return list(found.each())

    whole = aligned()
    monkeypatch.setattr(decontaminate.Diagonals, "PAIRS", 7)
    assert aligned() == whole
    nothing = decontaminate.leaks(docs_of(spark, ["no such words", None, ""]), spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id int, text string"))
    assert nothing.count() == 0


def test_overlap_equals_all_ranges():
    rng = np.random.default_rng(2)
    for _ in range(400):
        same = rng.random(rng.integers(0, 40)) < rng.choice([0.5, 0.8, 0.9])
        ranges = [(a, b) for a in range(len(same)) for b in range(a + 13, len(same) + 1) if same[a] and same[b - 1] and same[a:b].sum() >= 0.8 * (b - a) - 1e-9]
        assert decontaminate.overlap(same, 13, 0.8) == max(ranges, key=lambda r: (r[1] - r[0], -r[0]), default=None)


def test_leaks_survive_substitutions_and_clean_texts_stay(spark):
    rng = random.Random(9)

    def words(n):
        return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]

    items = [words(rng.randint(14, 60)) for _ in range(12)] + [words(8), words(3)]
    texts, expected = [*ODD], set()
    for i, item in enumerate(items):
        changed = list(item)
        for at in range(3, len(item) - 1, 6):
            changed[at] = "zzz"
        for version in (item, changed, [w.upper() + "," for w in item]):
            whole = version == item or version[0] != item[0]
            if len(item) >= 13 or (len(item) >= 5 and whole):
                expected.add((len(texts), i))
            texts.append(" ".join(words(rng.randint(0, 50)) + version + words(40)))
        half = list(item)
        half[::2] = ["zzz"] * len(half[::2])
        texts += [" ".join(words(20) + half + words(5)), " ".join(words(300)), " ".join(item[:12]) + " " + " ".join(words(30))]
        if 5 <= len(item) <= 12:
            expected.add((len(texts) - 1, i))
    benchmark = spark.createDataFrame([*enumerate(map(" ".join, items)), (0, " ".join(items[0])), (None, "x"), (99, None), (98, "")], "item_id int, text string")
    docs = docs_of(spark, texts)
    found = decontaminate.leaks(docs, benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected and found.count() == len(expected)
    assert got(decontaminate.leaks(docs, benchmark, block_bytes=700), "doc_id", "item_id", "start", "end", "n_same") == got(found, "doc_id", "item_id", "start", "end", "n_same")
    left = decontaminate.without_leaks(docs, benchmark)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), benchmark).count() == 0


# -- packing


def check_pieces(pieces, expected, limit):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(expected)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(expected[doc])
            assert p["ids_crc32"] == zlib.crc32(np.array(expected[doc][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(expected[doc])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding, by_sequence


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    plain, quick = Tokenizer.from_file(file), packing.WordIds(file)
    parts = ["a", "B", "e", "É", "ß", "İ", "I", "\u0307", "\u0301", ".", ",", "!", "?", ";", ":", "'s", "'LL", " ", "\n", "\t", "\r", "\xa0", "7", "÷", "日", "<|endoftext|>", "K", "\x1c", "#"]
    rng = random.Random(3)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    found = quick([x.encode() for x in texts])
    assert found == [np.array(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_packing_keeps_every_id_in_one_piece(spark):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    rng = random.Random(4)
    texts = [*ODD, "<|endoftext|> it's 12 ẞ İ é", *[" ".join(rng.choices([*WORDS, "Straße,", "naïve.", "don't", "3.14"], k=rng.randint(0, 900))) for _ in range(150)]]
    expected = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    out = packing.packed(docs_of(spark, texts), file)
    padding, _ = check_pieces(out.collect(), expected, 4096)
    assert padding == 0
    few = packing.Limits(tokens=512, segments=3, loss_tokens=400, window=16)
    padding, sequences = check_pieces(packing.packed(docs_of(spark, texts), file, limits=few).collect(), expected, 512)
    assert max(map(len, sequences.values())) <= 3 and padding == 0
    assert packing.packed(docs_of(spark, []), file).count() == 0


def test_examples_keep_three_limits(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(1, 300), rng.randint(0, 80)) for i in range(500)] + [(900, 0, 0), (901, None, None)]
    rows = [(i, n, b if n is None else min(n, b)) for i, n, b in rows]
    frame = spark.createDataFrame(rows, "doc_id long, n int, b int").coalesce(1)
    limits = packing.Limits(tokens=1000, segments=8, loss_tokens=200, window=64)
    out = packing.pack_examples(frame, "doc_id", "n", "b", limits).toPandas()
    assert sorted(out["doc_id"]) == [i for i, n, _ in rows if n] and (out["start"] == 0).all()
    by = out.groupby("sequence_id").agg(tokens=("length", "sum"), loss=("loss_length", "sum"), segments=("doc_id", "size"))
    assert (by["tokens"] <= 1000).all() and (by["loss"] <= 200).all() and (by["segments"] <= 8).all()
    # No more sequences than half again what the tightest limit needs.
    total = [sum(n or 0 for _, n, _ in rows) / 1000, sum(b or 0 for _, _, b in rows) / 200, 500 / 8]
    assert len(by) <= 1.5 * max(total)
    with pytest.raises(Exception, match="over the limits"):
        packing.pack_examples(spark.createDataFrame([(1, 2000, 5)], "doc_id long, n int, b int"), "doc_id", "n", "b", limits).collect()


# -- secrets


def all_spans(text, rules):
    found = []
    for order, rule in enumerate(rules):
        found += [(m.start(), order, m.end(), rule.kind) for m in rule.compiled().finditer(text or "") if len(m[rule.group]) >= rule.least]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def test_spans_equal_full_scans(spark):
    rng = random.Random(8)
    parts = ["password = abcd", "PassWD: 'S3cret/=_+value'", "api_key=", "apikey\"='0123456789", "AKIAABCDEFGHIJKL", "AKIAAAAAAAAAAAAA9", "AKIA1", "é" * 5, "ghp_" + "a1" * 20, "f" * 31, "0" * 40,
             "deadbeef" * 4 + "g", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "tokentoken: tokentoken:abcdefghij", "xoxb-1234567890-abc", "ſecret=longenough1"]
    texts = [*ODD, *[rng.choice(["", " ", "\n"]).join(rng.choices([*parts, *WORDS], k=rng.randint(0, 14))) for _ in range(300)]]
    out = secrets.secrets(docs_of(spark, texts)).collect()
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in out} == {i: all_spans(t, rules) for i, t in enumerate(texts)}
    # The run of hexadecimal digits is the same as all runs, the short ones dropped.
    import re

    for t in texts:
        assert [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32] == [s[1:] for s in all_spans(t, [r for r in rules if r.kind == "hex"])]
    assert secrets.secrets(docs_of(spark, [])).count() == 0


def test_trigram_queries():
    def of(pattern, **more):
        return secrets.trigram_query(secrets.Rule("x", pattern, **more))

    def code(s):
        return s[0] << 16 | s[1] << 8 | s[2]

    assert of("[0-9a-f]{32,}") == of("ab|c.*") == of("(abc)?") == secrets.ANY
    assert of("AKIA[A-Z0-9]+") == ("and", (code(b"aki"), code(b"kia")))
    assert of("x(abc|def)+y") == ("or", (code(b"abc"), code(b"def"))) or set(of("x(abc|def)+y")[1]) == {code(b"abc"), code(b"def")}
    assert of("ab[cd]") in [("or", (code(b"abc"), code(b"abd"))), ("or", (code(b"abd"), code(b"abc")))]
    assert of("foo.*bar") == ("and", (code(b"foo"), code(b"bar")))


# -- sharding


def test_shards_follow_the_key_law(spark):
    ids = [*range(3000), None, None, 5, 5]
    texts = [None, "", "é"] + [f"t{i}" for i in range(3, 3004)]
    tree = sharding.HashTree.regular(2, 2, 2)
    frame = docs_of(spark, texts, ids)
    out = sharding.sharded(frame, tree).toPandas()
    assert len(out) == len(ids) and set(out["shard"]) == set(range(8)) and set(out["grown_shard"]) == set(range(9))
    assert ((out["grown_shard"] == out["shard"]) | (out["grown_shard"] == 8)).all()
    assert 0.07 < (out["grown_shard"] == 8).mean() < 0.16 and out["shard"].value_counts(normalize=True).between(0.09, 0.16).all()
    assert out.groupby("doc_id", dropna=False)["shard"].nunique().max() == 1
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    first = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out[out["doc_id"] < 3].to_dict("records")}
    assert first == {0: (1, 0), 1: (1, 0), 2: (3, zlib.crc32("é".encode()))}
    assert sharding.sharded(frame.limit(0), tree).count() == 0
    kinds = {type(c).__name__ for c in sharding.sharded(frame, tree)._jdf.queryExecution().executedPlan().toString().split() if "Python" in c}
    assert not kinds


def test_weights_move_only_into_changed_subtrees(spark):
    leaves = [sharding.Leaf(r, k, 4 * r + 2 * k + s) for r in range(2) for k in range(2) for s in range(2)]
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 6 else 1.0) for x in leaves]
    ids = spark.range(4000).select("id", sharding.HashTree(leaves).shard(F.col("id")).alias("a"), sharding.HashTree(heavier).shard(F.col("id")).alias("b"))
    moved = ids.where("a != b").toPandas()
    assert len(moved) and (moved["b"] >= 4).all()  # into region 1, whose weight grew
    assert (moved.loc[moved["a"] >= 6, "b"] == 6).all() and (moved.loc[moved["a"].between(4, 5), "b"] >= 6).all()
    share = ids.where("b = 6").count() / 4000
    assert abs(share - 0.3) < 0.05


# -- nearest neighbours


def test_nearest_equal_all_products(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(700, 12)).astype(np.float32)
    base[100:400] = base[100]  # a third are copies
    base[500] *= 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(700, None), (701, [0.0] * 12), (702, [float("nan")] * 12), (703, [float("inf")] + [1.0] * 11), (704, [None] + [1.0] * 11), (705, []), (None, [1.0] * 12), (720, [1.0, 2.0]), (721, [3.0, 1.0]), (20, base[20].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    out = nearest.nearest(frame, F.col("vec_id") % 20 == 0, 20).toPandas()
    exact = base.astype(np.float64)
    for q in range(0, 700, 20):
        score = (exact * exact[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(700), -score)) if i != q][:20]
        own = out[out["query_id"] == q].sort_values("rank")
        assert own["vec_id"].tolist() == order and own["score"].tolist() == score[order].tolist()
    assert out[out["query_id"] == 720][["rank", "vec_id", "score"]].values.tolist() == [[1, 721, 5.0]]
    assert set(out["query_id"]) == {*range(0, 700, 20), 720}
    assert nearest.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 64)), rng.normal(size=(60, 64)) * rng.uniform(0.01, 100, (60, 1))
    (qa, sa, ca, ma), (qb, sb, cb, mb) = nearest.quantised(a), nearest.quantised(b)
    rough = (qa @ qb.T) * sa[:, None] * sb
    assert (np.abs(a @ b.T - rough) <= ma[:, None] * cb + np.linalg.norm(a, axis=1)[:, None] * mb + 1e-9).all()


# -- toxicity


def test_toxicity_finds_words_and_beginnings(spark):
    rng = random.Random(11)

    def text(bad):
        words = rng.choices([w + rng.choice(["", "s", "ly"]) for w in WORDS for _ in range(5)], k=rng.randint(5, 300))
        for _ in range(bad):
            words.insert(rng.randint(0, len(words)), rng.choice(["scumbag", "idiotic", "wretch" + rng.choice(["ed", "es", "ing", "ly", "est"])]))
        return " ".join(words)

    toxic = [rng.random() < 0.15 for _ in range(1500)]
    texts = [text(rng.randint(1, 5) if t else 0) for t in toxic]
    docs = docs_of(spark, [*texts, None, ""], [*range(1500), None, 2000])
    labels = spark.createDataFrame([(i, 0, int(t)) for i, t in enumerate(toxic)] + [(None, 1, 1), (3, 1, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, where=F.col("doc_id") % 3 != 0)
    out = toxicity.scored(docs, model, keep=["_row"]).toPandas()
    assert len(out) == 1502 and out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.5)).all()
    held = out[out["doc_id"] % 3 == 0].dropna(subset=["doc_id"])
    held = held[held["doc_id"] < 1500]
    truth = np.array(toxic)[held["doc_id"].astype(int)]
    assert held["predicted"][truth].mean() > 0.95 and held["predicted"][~truth].mean() < 0.01
    assert (out[out["doc_id"].isna() | (out["doc_id"] == 2000)]["predicted"] == 0).all()
    for some_docs, some_labels in ((docs, labels.limit(0)), (docs.limit(0), labels)):
        assert toxicity.scored(docs, toxicity.fit(some_docs, some_labels)).agg(F.max("predicted")).first()[0] == 0
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_negative_risk_is_kept_from_falling_below_zero():
    rng = np.random.default_rng(3)
    x = (rng.random((30, 60)) < 0.5).astype(np.float32)
    u = (rng.random((400, 60)) < 0.5).astype(np.float32)
    weights, bias = toxicity.nn_pu(x, u, 0.3, toxicity.PuConfig(steps=300, rate=0.1))
    at_u, at_x = u @ weights + bias, x @ weights + bias
    assert np.logaddexp(0, at_u).mean() - 0.3 * np.logaddexp(0, at_x).mean() > -0.1


# -- SimHash


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, ids, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [min((ids[k] for k in range(len(ids)) if root(k) == root(i) and ids[k] is not None), default=None) for i in range(len(ids))]


def near_texts(n, seed):
    rng = random.Random(seed)
    texts = [*ODD]
    for _ in range(n):
        words = rng.choices(WORDS, k=rng.randint(1, 200))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(["NEW", "É"])
            texts.append("\n".join(words))
    return texts


def test_groups_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "BAND", 2)
    texts = near_texts(120, 7)
    ids = [None if i == 3 else i for i in range(len(texts))]
    prints = [slow_fingerprint(t) for t in texts]
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == prints
    docs = docs_of(spark, texts, ids)
    out = simhash.near_duplicates(docs)
    groups = slow_groups(prints, ids, 3)
    assert got(out, "doc_id", "fingerprint", "component_id") == sorted(((i, f"{p:016x}", g) for i, p, g in zip(ids, prints, groups, strict=True)), key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups))


def test_links_join_what_all_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "BAND", 2)
    rng = random.Random(12)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for p in list(prints)[:60]:
        for _ in range(rng.randint(1, 6)):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << bit
            prints.add(p)
    prints = sorted(prints)
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for radius in (0, 3):
        groups = slow_groups(prints, list(range(len(prints))), radius)
        found = {r["node"]: r["root"] for r in components.components(simhash.links(fps, radius)).collect()}
        roots = [found.get(p - (1 << 64) if p >> 63 else p, p - (1 << 64) if p >> 63 else p) for p in prints]
        assert len({*zip(groups, roots, strict=True)}) == len(set(groups)) == len(set(roots))


def test_repeated_rows_and_empty_tables(spark):
    docs = docs_of(spark, ["a b c d"] * 4 + ["", None], [4, 4, 2, None, 9, 8])
    assert got(simhash.one_of_each(docs), "doc_id") == [(2,), (8,)]
    same = docs_of(spark, ["a b c d"] * 3, [1, 1, 1])
    assert simhash.one_of_each(same).count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(70, 71), (71, 70), (72, 72)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 50)}, 71: 70}


# -- lattice


def slow_marginal(word, table, by_byte):
    text = "▁" + word
    paths = [1.0] + [0.0] * len(text)
    for i in range(1, len(text) + 1):
        for j in range(i):
            p = table.get(text[j:i])
            if p is None and i - j == 1:
                p = np.prod([by_byte[b] for b in text[j].encode()])
            paths[i] += paths[j] * (p or 0)
    return paths[-1]


def tiny_pieces():
    names = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba", "c", "▁bc"]
    share = np.arange(1, len(names) + 258, dtype=float)
    hashes = np.array([lattice._hash(n) for n in names], np.uint64)
    order = np.argsort(hashes)
    share /= share.sum()
    sorted_share = np.concatenate((share[: len(names)][order], share[len(names) :]))
    pieces = lattice.Pieces(hashes[order], np.array([len(n) for n in names])[order], np.log(sorted_share))
    return pieces, dict(zip(names, share, strict=False)), share[len(names) : len(names) + 256], [names[i] for i in order]


def test_marginals_and_expected_uses_equal_enumeration():
    pieces, table, by_byte, names = tiny_pieces()
    rng = random.Random(1)
    words = ["a", "", "é", "▁a", *["".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(80)]]
    one = lattice.Lattice(pieces)
    assert np.allclose(np.exp(one.marginal(words)), [slow_marginal(w, table, by_byte) for w in words], rtol=1e-10)
    # A piece's expected uses are the derivative of the log-likelihood by its log probability.
    counts = np.array([rng.randint(0, 4) for _ in words], float)
    uses = one.expected(words, counts)
    for name in ("a", "ab", "▁a"):
        at = names.index(name)
        shifted = lattice.Pieces(pieces.hashes, pieces.sizes, pieces.log_p.copy())
        shifted.log_p[at] += 1e-5
        slope = (lattice.Lattice(shifted).marginal(words) - one.marginal(words)) @ counts / 1e-5
        assert abs(slope - uses[at]) < 1e-3


def test_scores_equal_word_by_word(spark, monkeypatch):
    monkeypatch.setattr(lattice, "HEAD", 8)
    rng = random.Random(5)
    texts = [*ODD, *[" ".join(rng.choices([*WORDS, "Alpha", "été", f"n{rng.random()}"], weights=[9] * len(WORDS) + [1, 1, 3], k=rng.randint(0, 60))) for _ in range(90)]]
    ids = [*range(len(texts) - 1), None]
    frame = docs_of(spark, texts, ids)
    train = [i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i in ids]
    file = public_tokenizers.path("piece_bpe_32k.model")
    out = {r["doc_id"]: r for r in lattice.scored(frame, file, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1).collect()}
    words = [(t or "").encode().lower().split() for t in texts]
    count = Counter(w for ws, t in zip(words, train, strict=True) if t for w in ws)
    n_end = sum(train)
    n, v = sum(count.values()) + n_end, len(count) + 1
    table = spark.createDataFrame([(w, c) for w, c in count.items()], "word binary, c long")
    start = lattice.Pieces.read(file)
    pieces = lattice.fit(table, n_end, start)
    one = lattice.Lattice(pieces)
    price = dict(zip(sorted({w for ws in words for w in ws}), one.marginal([w.decode() for w in sorted({w for ws in words for w in ws})]), strict=True))
    likelihood = [sum(c * p for (_, c), p in zip(count.items(), lattice.Lattice(x).marginal([w.decode() for w in count]), strict=True)) + n_end * x.log_p[x.end] for x in (start, lattice.fit(table, n_end, start, 1, 0.0), lattice.fit(table, n_end, start, 2, 0.0))]
    assert likelihood[0] < likelihood[1] < likelihood[2]
    assert len(out) == len(ids)
    for i, ws in zip(ids, words, strict=True):
        r = out[i]
        base = sum(log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + log10((n_end + 0.5) / (n + 0.5 * (v + 1)))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx((sum(price[w] for w in ws) + pieces.log_p[pieces.end]) / np.log(10), rel=1e-9)


def test_lattice_of_empty_tables(spark):
    file = public_tokenizers.path("piece_bpe_32k.model")
    assert lattice.scored(docs_of(spark, []), file, F.lit(True)).count() == 0
    only = lattice.scored(docs_of(spark, ["a b", None]), file, F.lit(False)).toPandas().sort_values("doc_id")
    assert only["n_known"].tolist() == [0, 0] and only["train_tokens"].tolist() == [0, 0] and only["base_score"].tolist() == [0.0, 0.0]
    assert isinstance(only, pd.DataFrame) and (only["score"] < 0).all()
