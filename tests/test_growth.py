"""What steps of queries hold at most, on tables small enough to be compared with brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import corpus, nearest, semantic
from lexloom.plans import registry


def last_execution(spark):
    spark.range(1).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    return max(e.executionId() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.sharedState().statusStore().executionsList()))


def most_rows(spark, since):
    """The most rows that any step of the executions after `since` put out."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    store, convert, most = spark._jsparkSession.sharedState().statusStore(), spark._jvm.scala.jdk.javaapi.CollectionConverters, 0
    for e in convert.asJava(store.executionsList()):
        if e.executionId() > since:
            values = {int(k): v for k, v in dict(convert.asJava(store.executionMetrics(e.executionId()))).items()}
            for node in convert.asJava(store.planGraph(e.executionId()).allNodes()):
                for m in convert.asJava(node.metrics()):
                    if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())):
                        most = max(most, int(v.replace(",", "")))
    return most


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """600 vectors that are all alike, of which one stands five times."""
    r = random.Random(3)
    rows = [(i, [1 + r.random() for _ in range(64)], i % 3) for i in range(600)]
    rows += [(600 + i, rows[7][1], 1) for i in range(4)]
    at = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at, rows


@pytest.mark.parametrize("name", ["embedding_neighbours", "adaptive_neighbours", "fused_neighbours", "mutual_neighbours", "merged_relationships", "related_one_hop"])
def test_pairs_of_vectors_are_no_rows(spark, vectors, name):
    at, rows = vectors
    since = last_execution(spark)
    registry.queries()[name](spark, at).collect()
    assert 0 < most_rows(spark, since) < 40 * len(rows)  # all pairs are 301 for each


@pytest.mark.parametrize("block, group", [(8192, 131_072), (50, 131_072), (64, 100)])
def test_blocks_and_groups_of_vectors_give_one_graph(spark, vectors, monkeypatch, block, group):
    at, rows = vectors
    monkeypatch.setattr(nearest, "GROUP", group)
    got = {(r["source"], r["target"], r["rank"]): r["score"] for r in semantic.embedding_graph(registry._vectors(spark, at), 5, digits=6, block=block).collect()}
    unit = [[x / sum(y * y for y in v) ** 0.5 for x in v] for _, v, _ in rows]
    want = {}
    for i, a in enumerate(unit):
        near = sorted((-round(sum(x * y for x, y in zip(a, b)), 6), j) for j, b in enumerate(unit) if j != i)
        want |= {(i, j, rank): -s for rank, (s, j) in enumerate(near[:5], 1)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert [(7, 600 + i, i + 1) in got for i in range(4)] == [True] * 4


def test_one_hop_follows_every_vector_of_a_label(spark, vectors):
    at, rows = vectors
    label = {i: x for i, _, x in rows}
    graph = {(r["source"], r["target"]) for r in registry.embedding_neighbours(spark, at).collect()}
    got = {(r["query_id"], r["id"]): r["sources"] for r in registry.related_one_hop(spark, at).collect()}
    want = {}
    for s, t in graph:
        want[label[s], t] = want.get((label[s], t), 0) + 1
    assert got == want


def test_phrases_before_acronyms_are_those_of_the_rule(spark):
    r = random.Random(8)
    parts = ["Content", "delivery", "network", "of", "a/b", "9th", "3x", "it's", "x-y", "(CDN)", "( CDN )", "(Cd N)", "(cdn)", "()", "(", ")", "e.g.", "é", "CDN", "ABC", "-", "(ABc9)", "((CDN))", "1a2b"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(str(i), x, "") for i, x in enumerate(texts)], "id string, title string, body string")
    _, pattern, key_at, phrase_at = corpus._RULES[0]
    pairs = F.arrays_zip(F.regexp_extract_all("title", F.lit(pattern), F.lit(key_at)).alias("k"), F.regexp_extract_all("title", F.lit(pattern), F.lit(phrase_at)).alias("p"))
    want = sorted((x["id"], x["p"]["k"], x["p"]["p"]) for x in docs.select("id", F.explode(pairs).alias("p")).collect())
    assert len(want) > 100 and sorted((x["id"], x["surface"], x["said"]) for x in corpus._phrases_before(docs).collect()) == want


def test_mining_writes_no_phrase_that_no_acronym_asks_for(spark):
    r = random.Random(2)
    words = ["".join(r.choice("bcdfg") for _ in range(7)) for _ in range(400)]
    docs = spark.createDataFrame([(str(i), "", " ".join(r.choice(words) for _ in range(500)) + (" Quick Zebra (QZ)" if i < 3 else "")) for i in range(30)], "id string, title string, body string")
    since = last_execution(spark)
    got = {x["id"]: x for x in corpus.mine_equivalences(docs).collect()}
    assert set(got) == {"eq:qz:quick-zebra"} and got["eq:qz:quick-zebra"]["phrase_df"] == 3
    assert most_rows(spark, since) < 2000  # the phrases of two to six words are 74,000


@pytest.fixture(scope="module")
def prose(spark, tmp_path_factory):
    """40 documents of 500 words of their own and three that all have; items ask for the three and some."""
    r = random.Random(6)
    words = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n)]
    texts = [" ".join(["alpha"] + words(500) + ["beta", "gamma"] * (i % 3)) for i in range(40)]
    at = str(tmp_path_factory.mktemp("prose"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta"), (2, "gamma " + texts[5].split()[9])], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name", ["search_bm25", "search_bm25_whole"])
def test_words_that_no_query_asks_for_are_no_rows(spark, prose, name):
    since = last_execution(spark)
    got = registry.queries()[name](spark, prose).collect()
    assert len(got) == 10 and most_rows(spark, since) < 1000  # postings are 20,000 for each field


@pytest.mark.parametrize("name", ["phrase_frequencies", "document_frequencies"])
def test_words_are_not_counted_by_several_shuffles(spark, prose, name):
    """Words are counted in their tasks, then one shuffle by word; before, a shuffle by document and word came first."""
    plan = registry.queries()[name](spark, prose)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


def test_pairs_of_titles_are_no_rows(spark, tmp_path):
    """Titles that share a word meet as blocks, not as rows."""
    r = random.Random(9)
    texts = ["common " + "".join(r.choice("abcdefgh") for _ in range(6)) + f" {i % 7}7" for i in range(500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    since = last_execution(spark)
    assert len(registry.lexical_neighbours(spark, str(tmp_path)).collect()) == 2500
    assert most_rows(spark, since) < 40 * len(texts)  # all pairs are 249 for each
