"""A corpus from raw documents to training sequences; each stage's result is written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import decontaminate, line_dedup, near_copies, packing, toxicity
from paceframe.llm.batches import folded
from paceframe.llm.queries import MIN_DOCS, WORD_VOCABULARY, remainder
from paceframe.runtime import written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. Other columns may have any name; an empty table stays empty."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=remainder() != 0)
    narrow, back = folded(docs, "doc_id", "text")
    return back(toxicity.scored(narrow, model, keep=["text", "_folded"]).where("predicted = 0"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; ``n_chars`` follows the text. Documents stay. Other columns may have any name."""
    index = line_dedup.LineIndex.empty(spark, MIN_DOCS).insert(docs)
    narrow, back = folded(docs, "doc_id", "text", "n_chars")
    kept = line_dedup.drop_lines(narrow, index, keep=["_folded"])
    return back(kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast(docs.schema["n_chars"].dataType)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash of five-word shingles within 3 bits, or their sets' similarity 0.8 or more."""
    return near_copies.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, packed into training sequences."""
    return packing.packed(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("decontaminate", benchmark),
    ("packing", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate results are tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
