"""The registered queries with SQL against it, and the pipeline against brute force, on the smallest tables."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from oracle import connect, differences  # noqa: E402
from test_llm_operators import check_pieces, kept_lines, slow_fingerprint, slow_groups  # noqa: E402

from paceframe.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    assert differences(queries.QUERIES[name](spark, sf), connect(sf), queries.SQL[name]) == []


def ordinary_words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").replace(".", " ").replace(",", " ").split()


def test_stages_equal_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    syllables = "ba de fi go ku la me ni po ru sa te vi zo".split()

    def words(n):
        return ["".join(rng.choices(syllables, k=3)) for _ in range(n)]

    items = [words(rng.randint(15, 40)) for _ in range(5)]
    footer = " All rights reserved, line of many "
    rows, toxic, leaked = [], set(), set()
    for i in range(400):
        body = words(rng.randint(20, 120))
        if rng.random() < 0.15:
            toxic.add(i)
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["scumbag", "wretched"]))
        if rng.random() < 0.1:
            leaked.add(i)
            at = rng.randrange(len(body))
            body[at:at] = rng.choice(items)
        text = " ".join(body[:15]) + "\n" + " ".join(body[15:])
        rows.append((i, text + ("\n" + footer if rng.random() < 0.3 else "")))
    rows += [(400 + k, rows[k][1]) for k in range(0, 60, 3)]  # exact copies
    toxic |= {400 + k for k in range(0, 60, 3) if k in toxic}
    leaked |= {400 + k for k in range(0, 60, 3) if k in leaked}
    rows += [(500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    state, held = dict(rows), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, str(tmp_path))
        if name == "packing":
            break
        out.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        assert held.columns == docs.columns and held.dtypes == docs.dtypes
        if name == "toxicity":
            state = {i: t for i, t in state.items() if i not in toxic}
        elif name == "line_dedup":
            state = {i: kept for i, (_, _, kept) in zip(state, kept_lines(list(state.values()), 10), strict=True)}
            assert held.where(F.col("n_chars") != F.length("text")).count() == 0
            assert not any("rights" in t for t in state.values())
        elif name == "simhash":
            ids = list(state)
            groups = slow_groups([slow_fingerprint(state[i]) for i in ids], ids, 3)
            state = {i: state[i] for i in sorted(set(groups))}
        elif name == "decontaminate":
            state = {i: t for i, t in state.items() if not any(" ".join(w) in " ".join(ordinary_words(t)) for w in items)}
            assert not leaked & set(state)
        assert {r["doc_id"]: r["text"] for r in held.collect()} == state, name
    tokenizer = Tokenizer.from_file(queries.public_tokenizers.path(queries.WORD_VOCABULARY))
    expected = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in state.items()}
    padding, _ = check_pieces(out.collect(), expected, 4096)
    assert padding == 0
    whole = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in whole} == {i: len(x) for i, x in expected.items()}
