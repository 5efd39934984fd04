"""Each operator of this subpackage over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontamination, html_text, mixing, ngram_join, paragraph_dedup, pii, quality_rules, sharding, suffix_dedup, token_counts
from lexloom.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass the compression bands, with what was measured."""
    judged = quality_rules.compression_verdicts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.where("quality.reason is null").select("doc_id", "quality.bytes", "quality.ratio", "quality.least_chunk", "quality.most_chunk", "quality.chunks")


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.inline("pii"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_token_counts(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(read(spark, sf_dir, "documents"))


def op5_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op6_paragraph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(read(spark, sf_dir, "documents"))


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.with_copies(read(spark, sf_dir, "documents")).select("doc_id", "source", "n_chars", "copies")


def op8_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.benchmark_hits(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("hits"))


def op9_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that is similar to another: its class, its copies and its links to different texts."""
    return ngram_join.near_copies(read(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extracted(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "main.title", "main.text", "main.density")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_pii_spans, op3_token_counts, op4_hilbert_shards, op5_suffix_passages, op6_paragraph_clusters, op7_pivotal_mixing, op8_benchmark_hits, op9_jaccard_pairs, op10_html_text)
    return {f.__name__: f for f in own}


def _op4_sql() -> str:
    bits, names = sharding.BITS, sharding.DIMENSIONS
    side = 1 << bits
    ranks = ", ".join(f"(rank() OVER (ORDER BY {n} NULLS FIRST) - 1) * {side} // count(*) OVER () AS b{i}" for i, n in enumerate(names))
    code = "0"
    for i in range(len(names)):
        code = f"({code}) * {side} + b{i}"
    return f"""
WITH ranked AS (SELECT *, {ranks} FROM documents),
placed AS (SELECT doc_id, text, lang, source, n_chars, CAST(({sharding.curve_table(len(names), bits)})[CAST({code} AS INTEGER) + 1] AS BIGINT) AS curve FROM ranked)
SELECT *, CAST(coalesce(sum(coalesce(strlen(text), 0)) OVER (ORDER BY curve, doc_id NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) // {sharding.SHARD_BYTES} AS BIGINT) AS shard
FROM placed"""


def _op5_sql() -> str:
    n = suffix_dedup.LENGTH
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS rk, * FROM (SELECT DISTINCT doc_id, text FROM documents)),
parted AS (SELECT rk, doc_id, list_filter(string_split_regex(text, '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS ws FROM texts),
placed AS (SELECT rk, doc_id, ws, unnest(range(0, len(ws) - {n - 1})) AS a FROM parted WHERE len(ws) >= {n}),
keyed AS (SELECT rk, doc_id, a, md5(array_to_string(ws[a + 1 : a + {n}], ' ')) AS k FROM placed),
seen AS (SELECT k, min(doc_id) AS first, min(rk) AS lo, max(rk) AS hi FROM keyed GROUP BY k),
shared AS (SELECT rk, doc_id, a, first FROM keyed JOIN seen USING (k) WHERE lo <> hi),
cut AS (SELECT *, CASE WHEN a <= lag(a) OVER (PARTITION BY rk ORDER BY a) + {n} THEN 0 ELSE 1 END AS new FROM shared),
island AS (SELECT *, sum(new) OVER (PARTITION BY rk ORDER BY a) AS i FROM cut)
SELECT doc_id, CAST(min(a) AS INTEGER) AS start_word, CAST(max(a) + {n} AS INTEGER) AS stop_word, min(first) AS first_doc_id
FROM island GROUP BY rk, doc_id, i"""


def oracle_sql() -> dict[str, str]:
    return {"op4_hilbert_shards": _op4_sql(), "op5_suffix_passages": _op5_sql()}
