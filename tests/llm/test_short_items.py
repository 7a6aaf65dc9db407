"""Benchmark items of fewer than five tokens in op3's report."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

from paceframe.llm import queries  # noqa: E402


def test_items_below_five_tokens_are_reported(spark, tmp_path):
    items = ["Yes!", "two words", "one two three", "w x y z", "two  WORDS"]
    texts = ["no; yes, yes", "two", "words two words two words", "one two", "three", "0 one two-three w x y z", None, "", "w x y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = [(0, 0, 1, 2, 0, 1, 1), (2, 1, 1, 3, 0, 2, 2), (2, 4, 1, 3, 0, 2, 2), (5, 2, 1, 4, 0, 3, 3), (5, 3, 4, 8, 0, 4, 4)]
    assert sorted(map(tuple, queries.op3_decontaminate(spark, str(tmp_path)).collect())) == expected
