"""The operators as queries over the driver tables, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.llm import alignment, decontaminate, lattice, line_dedup, nearest, packing, prefix_trie, secrets, sharding, simhash, toxicity, url_filter, warc

# The rules that the url query applies.
URL_RULES = (
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
)
MIN_DOCS = 10
WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules; urls without a rule are allowed."""
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more dropped from all documents."""
    docs = table(spark, sf_dir, "documents")
    index = line_dedup.LineIndex.empty(spark, MIN_DOCS).insert(docs)
    kept = line_dedup.drop_lines(docs, index)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the items and places."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True).drop("_row")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: numbers of the base kinds, their digest, and all spans."""
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    digest = F.sha2(joined(of(*base)).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, joined(F.col("spans")).alias("spans"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of two regions of two racks, and in nine."""
    placed = sharding.sharded(table(spark, sf_dir, "documents"), sharding.HashTree.regular(2, 2, 2))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; the classifier never sees the rows whose remainder is 0."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=remainder() != 0)
    scored = toxicity.scored(docs, model)
    return scored.select("doc_id", (F.coalesce(remainder(), F.lit(-1)) == 0).alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and group of near-duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under the subword model and under word counts."""
    docs = table(spark, sf_dir, "documents")
    scored = lattice.scored(docs, public_tokenizers.path(PIECE_VOCABULARY), remainder() != 1)
    return scored.withColumn("held_out", F.coalesce(remainder(), F.lit(-1)) == 1)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to archives and read back."""
    found = warc.Archive.write(table(spark, sf_dir, "pages")).read(payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every common beginning of the conversations, which share their heads in groups of twenty."""
    turns, lengths = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.PrefixTrie.empty(spark).insert(turns, lengths).expanded()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups of byte-level tokens and pieces, and how common their links are over all documents."""
    found = alignment.groups(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_VOCABULARY))
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    counted = alignment.with_counts(found.select("doc_id", *alignment.COUNTS, digest, "pairs", "times"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_line_dedup, op3_decontaminate, op4_packing, op5_secrets, op6_sharding, op7_nearest, op8_toxicity, op9_simhash, op10_lattice,
        op11_warc, op12_prefix_trie, op13_alignment,
    )
}

_TRIMMED = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op1_url_filter": f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS whole FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(whole, '^[^/]*'), '{_UPPER}', '{_LOWER}') AS host, substr(whole, length(regexp_extract(whole, '^[^/]*')) + 1) AS path FROM cut
        ), rules(rule_host, rule_path, verdict) AS (
            VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)}
        ), fits AS (
            SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
            FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
    """,
    # rows are numbered, since each row is a document, whatever its id
    "op2_line_dedup": f"""
        WITH numbered AS (
            SELECT doc_id, row_number() OVER () AS doc, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), lines AS (
            SELECT doc_id, doc, pos, lines[pos] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS pos FROM numbered)
        ), keyed AS (
            SELECT *, translate({_TRIMMED}, '{_UPPER}', '{_LOWER}') AS key FROM lines
        ), frequent AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= {MIN_DOCS}
        )
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f ON keyed.key = f.key GROUP BY doc_id, doc
    """,
}
