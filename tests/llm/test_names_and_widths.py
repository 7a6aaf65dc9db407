"""Stages on tables whose columns have the names that operators use inside, and neighbours of wide vectors."""

import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402

from paceframe.llm import nearest, packing  # noqa: E402
from paceframe.llm.batches import folded  # noqa: E402

CLASHING = ["predicted", "score", "_none", "kept", "n_lines", "n_dropped", "_row", "_rest", "_folded", "c0", "root", "rid", "a.b", "_text", "_id", "none"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns_of_any_name(spark, tmp_path, stage, empty):
    texts = ["one two three four five six seven", "alpha beta gamma delta epsilon zeta eta theta", None, "", "footer\nsomething else here altogether now", "x y z " * 3000]
    rows = [(i, t, len(t or ""), *[f"{c}{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    names = ", ".join(["doc_id long", "text string", "n_chars long", *[f"`{c}` string" for c in CLASHING]])
    docs = spark.createDataFrame([] if empty else rows, names)
    spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    found = out.collect()
    if stage == "packing":
        assert {r["doc_id"] for r in found} == (set() if empty else set(range(len(texts))))
        return
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert empty or found
    for r in found:
        assert [r[c] for c in CLASHING] == [f"{c}{r['doc_id']}" for c in CLASHING]


def test_folding_and_back_changes_nothing(spark):
    df = spark.createDataFrame([(1, "t", "x", None)], "doc_id long, text string, `odd.name` string, _folded int")
    narrow, back = folded(df, "doc_id", "text")
    assert narrow.columns == ["doc_id", "text", "_folded"]
    assert back(narrow).collect() == df.collect() and back(narrow).columns == df.columns


@pytest.mark.parametrize("width", [64, 1041, 2048, 4096])
def test_nearest_is_exact_at_any_width(spark, width):
    """Whole numbers up to 127 are their own codes, so nothing but the sum of products can go wrong."""
    rng = np.random.default_rng(width)
    vectors = rng.integers(90, 128, (160, width)).astype(np.float64)
    vectors[:, 0] = 127
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    found = nearest.nearest(df, df["vec_id"] % 20 == 0).collect()
    scores = vectors[::20] @ vectors.T
    for q in range(0, 160, 20):
        order = sorted((i for i in range(160) if i != q), key=lambda i: (-scores[q // 20, i], i))[:20]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert own == [(n + 1, i, scores[q // 20, i]) for n, i in enumerate(order)]


def test_products_are_exact():
    a = np.full((2, 4096), 127, np.float32)
    a[1, ::3] = 126
    assert nearest.products(a, a).tolist() == (a.astype(np.int64) @ a.astype(np.int64).T).tolist()


def test_blocks_of_queries_meet_every_group(spark, monkeypatch):
    for name, value in (("QUERIES", 3), ("CANDIDATES", 16), ("GROUP", 2), ("ASKED", 2)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(700, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    found = nearest.nearest(df, df["vec_id"] % 20 == 0).collect()
    scores = vectors @ vectors.T
    assert len(found) == 35 * 20
    for r in found:
        order = np.argsort(-np.delete(scores[r["query_id"]], r["query_id"]), kind="stable")
        place = order[r["rank"] - 1]
        assert r["vec_id"] == place + (place >= r["query_id"])


def test_waiting_examples_are_bounded_by_their_ids(monkeypatch):
    monkeypatch.setattr(packing, "WAITING", 10_000)
    packer = packing.Packer(packing.Limits(), True, 0)
    most = 0
    for i in range(200):
        packer.add(i, 3000, 2999)
        most = max(most, sum(p.tokens for p in packer.pieces))
    packer.finish()
    assert most <= 13_000
    placed = {}
    for example, start, length, *_ in packer.done:
        placed.setdefault(example, []).append((start, length))
    assert all(sum(n for _, n in p) == 3000 for p in placed.values()) and len(placed) == 200


def test_a_worker_keeps_one_tokenizer_whose_setting_returns():
    file = public_tokenizers.path("word_bpe_49k.json")
    ids = packing.WordIds.of_worker(file)
    assert packing.WordIds.of_worker(file) is ids
    plain = Tokenizer.from_file(file)
    texts = ["a <|endoftext|> b", "a <| endoftext b", "", "Café, naïve words", "x<|startoftext|>"]
    expected = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for order in (texts, texts[::-1]):
        got = dict(zip(order, ids([t.encode() for t in order]), strict=True))
        assert [got[t] for t in texts] == expected
    assert ids.tokenizer.encode_special_tokens


def test_runs_of_marks_are_chunks_of_their_own_and_ids_stay():
    """Marks after a-z are looked up apart from the word; ids are those of the tokenizer for the whole text."""
    file = public_tokenizers.path("word_bpe_49k.json")
    words = packing.WordIds(file)
    words([b"swim.### run,%%% swim run"])
    assert {"swim", "run", ".###", ",%%%"} <= words.known.keys() and "swim.###" not in words.known
    rng = random.Random(4)
    bits = ["a", "run", "Don't", "it's", "x9", "9", "é", "É", "ß", "…", "'", "''", "'s", ".", "!?", "%%%", "_", "-", "<|", "|>", "\u0301", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "中", "\x00"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3000)]
    plain = Tokenizer.from_file(file)
    expected = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words([t.encode() for t in texts]) == expected
