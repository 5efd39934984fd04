"""Documents made ready for training: five stages, each written as Parquet and read again by the next.

What holds for every stage: columns of any name stay (the last adds curve and shard, replacing columns so named), an empty
table stays empty, texts are read whole, and what a stage decides about a row doesn't depend on columns that it doesn't name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.common import discard, read, written
from lexloom.llm.decontamination import decontaminate
from lexloom.llm.mixing import mixture
from lexloom.llm.ngram_join import drop_near_copies
from lexloom.llm.quality_rules import quality_filter
from lexloom.llm.sharding import hilbert_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts go, as do those outside the compression bands; rows that repeat all stay or all go."""
    return quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id (nulls last); of rows that repeat id and text one. Documents
    without words would all stay, but the stage before has none."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; null and empty items match nothing, those shorter than a piece are not looked for."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture says; a null source is a source of its own, rows that repeat are dealt their copies evenly."""
    return mixture(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in order of the curve and of their ids, nulls first; rows that repeat share a shard."""
    return hilbert_shards(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination), ("mixing sources to target weights", source_mixing), ("sharding", sharding)]

#: Compression, approximate search and dependent rounding can't be said in SQL; the tests compare with a version by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
