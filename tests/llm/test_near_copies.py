"""Near copies by Jaccard similarity against all pairs, in the operator and in the pipeline's stage."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from test_llm_operators import ODD, WORDS, docs_of, got  # noqa: E402

from paceframe.llm import near_copies, simhash  # noqa: E402


def slow_shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_groups(texts, ids, ratio=0.8):
    """The smallest id that links of the given Jaccard similarity reach."""
    sets, seen, out = [slow_shingles(t) for t in texts], {}, [None] * len(texts)
    near = [[j for j in range(len(sets)) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= ratio * len(sets[i] | sets[j]) > 0] for i in range(len(sets))]
    for i in range(len(sets)):
        todo = [] if i in seen else [i]
        while todo:
            j = todo.pop()
            if j not in seen:
                seen[j] = i
                todo += near[j]
    for i in range(len(sets)):
        out[i] = min((ids[j] for j in seen if seen[j] == seen[i] and ids[j] is not None), default=None)
    return out


def near_copies_of(n, seed):
    """Random texts, and copies of them with changed words: similarities from 0.5 to 0.99."""
    rng = random.Random(seed)
    texts = [*ODD, "a b c", "A  b c", "a b d"]
    for _ in range(n):
        words = [f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(rng.randint(40, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(rng.randint(1, len(words) // 20)):
                copy[rng.randrange(len(copy))] = "NEW"
            texts.append("\n".join(copy))
    return texts


def test_near_copies_equal_all_pairs(spark, monkeypatch):
    texts = near_copies_of(150, 5)
    ids = [None if i == 3 else i for i in range(len(texts))]
    docs, groups = docs_of(spark, texts, ids), similar_groups(texts, ids)
    for tile in (256, 2):
        monkeypatch.setattr(near_copies, "TILE", tile)
        kept = near_copies.one_of_each(docs)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups))
    assert near_copies.one_of_each(docs.limit(0)).count() == 0
    repeated = docs_of(spark, ["a b c d"] * 4 + ["", None], [4, 4, 2, None, 9, 8])
    assert got(near_copies.one_of_each(repeated), "doc_id") == [(2,), (8,)]


def test_near_copies_of_similarity_from_four_fifths_go(spark):
    texts = near_copies_of(60, 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(similar_groups(texts, list(range(len(texts))))))


def test_the_stage_links_by_fingerprints_too(spark):
    """Texts whose repeats decide the fingerprint: their sets are far apart, the fingerprints are not."""
    rng = random.Random(3)
    often = "run rest swim rest ride " * 200
    texts = [often + " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)), "", "one", "two words"]
    marks = [simhash.fingerprint(t.encode(), 5) for t in texts]
    assert all((marks[0] ^ m).bit_count() <= 3 for m in marks[:3]) and all((a ^ b).bit_count() > 3 for i, a in enumerate(marks[2:]) for b in marks[2:][:i])
    sets = [slow_shingles(t) for t in texts]
    assert len(sets[0] & sets[1]) < 0.1 * len(sets[0] | sets[1])
    docs = spark.createDataFrame([(9 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == [3, 4, 5, 6, 7]


def test_minima_are_spread_evenly():
    """Each shingle of a set, multiples of powers of two and zero too, is the least of its hashes about equally often."""
    own = np.array([0, 1, 2, 3, *(1 << b for b in range(20, 32))], np.uint64)
    values = near_copies.FACTORS[:, None] * own[None, :] + near_copies.ADDENDS[:, None]
    assert np.bincount(values.argmin(axis=1), minlength=len(own)).max() < len(values) / 4
    left, right = (np.unique(np.random.default_rng(7).integers(0, 1 << 63, 900, dtype=np.uint64)[a : a + 800]) for a in (0, 100))
    shared = np.mean(near_copies.bands(left) == near_copies.bands(right))
    assert 0.1 < shared < 0.7  # 7 / 9 to the fourth is 0.37
