"""Both ways to number shards, and what the files' statistics leave out of a read."""

from __future__ import annotations

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.llm import sharding


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    rows = [(i, "x" * (n := int(2 ** r.uniform(3, 11))), r.choice(["de", "en", "en", "fr", None]), r.choice("abcdef"), n, "x") for i in range(1500)] + [(None, None, None, "a", None, "y")] * 3
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size string")


def test_both_ways_give_the_same_shards(docs):
    few = sharding.hilbert_shards(docs, shard_bytes=20_000)
    want = sorted((str(x["doc_id"]), x["curve"], x["shard"]) for x in few.collect())
    assert few.columns == [*docs.columns, "curve", "shard"] and len({x[2] for x in want}) > 10
    joined = sharding.hilbert_shards(docs, shard_bytes=20_000, most_starts=0)
    assert sorted((str(x["doc_id"]), x["curve"], x["shard"]) for x in joined.collect()) == want
    named = sharding.hilbert_shards(docs.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0")), shard_bytes=20_000)
    assert sorted((str(x["doc_id"]).lstrip("0") or ("None" if x["doc_id"] is None else "0"), x["curve"], x["shard"]) for x in named.collect()) == want


def test_file_statistics_leave_most_files_out(spark, docs, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        sharding.hilbert_shards(docs, shard_bytes=8_000).write.parquet(f"{tmp_path}/sharded")
        docs.repartition(24).write.parquet(f"{tmp_path}/plain")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

    def read(folder):
        """Files, and how many of them may hold French texts of 100 to 300 characters by their statistics."""
        files = glob.glob(f"{tmp_path}/{folder}/*.parquet")
        held, runs = 0, []
        for f in files:
            m = pq.read_metadata(f)
            names = [m.row_group(0).column(k).path_in_schema for k in range(m.num_columns)]
            lang, n = (m.row_group(0).column(names.index(c)).statistics for c in ("lang", "n_chars"))
            held += bool(lang.has_min_max and n.has_min_max and lang.min <= "fr" <= lang.max and n.min <= 300 and n.max >= 100)
            if "shard" in names:
                s = m.row_group(0).column(names.index("shard")).statistics
                runs.append((s.min, s.max))
        return len(files), held, sorted(runs)

    files, held, runs = read("sharded")
    assert files >= 20 and all(a[1] < b[0] for a, b in zip(runs, runs[1:]))
    assert held <= files / 3 and read("plain")[1] == read("plain")[0]
