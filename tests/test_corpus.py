"""Mining and review on a few documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexloom.errors import InvalidArtifactError
from lexloom.operators import corpus, metrics, relgraph, semantic

DOCS = [
    ("a", "Content Delivery Network (CDN)", "A content delivery network (CDN) moves content. CDN stands for content delivery network."),
    ("b", "CDN basics", "The content delivery network is close to users."), ("c", "Auth notes", "authentication aka login; auth works"), ("d", "Authentication", "auth auth and authentication"), ("e", "More auth", "auth"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, title string, body string")


def test_acronyms(docs):
    rows = {r["id"]: r for r in corpus.mine_equivalences(docs).collect()}
    cdn = rows["eq:cdn:content-delivery-network"]
    assert cdn["decision"] == "accepted" and cdn["explicit_docs"] == 1 and cdn["title_key_df"] == 2 and cdn["phrase_df"] == 2


def test_synonyms_and_vocabulary(docs):
    v = corpus.mine_vocabulary(docs)
    terms = {r["term"]: r for r in v.collect()}
    assert terms["auth"]["df"] == 3 and terms["auth"]["title_df"] == 2 and "moves" not in terms
    assert {tuple(r["terms"]) for r in corpus.mine_synonyms(docs).collect()} >= {("authentication", "login"), ("auth", "authentication")} - {("auth", "authentication")}


def test_lifecycle(spark):
    candidates = spark.createDataFrame([("1", "k", "accepted", 3), ("2", "k", "review", 1), ("3", "m", "rejected", 0), ("4", "n", "review", 0), ("5", "o", "accepted", 1)], "id string, key string, decision string, supporting int")
    decisions = spark.createDataFrame([("2", "k", "accept"), ("4", "n", "reject"), ("9", "z", "reject")], "id string, key string, verdict string")
    rows = corpus.apply_lifecycle(candidates, decisions)
    assert {r["id"]: r["state"] for r in rows.collect()} == {"1": "CONFLICT", "2": "HUMAN_ACCEPTED", "3": "COMPILER_REJECTED", "4": "HUMAN_REJECTED", "5": "AUTO_ACCEPTED", "9": "ORPHANED_DECISION"}
    assert {r["id"] for r in corpus.trusted(rows).collect()} == {"2", "5"}


def test_graphs(spark):
    g = spark.createDataFrame([("a", "b", 0.9, 1), ("b", "a", 0.9, 1), ("a", "c", 0.2, 2)], "source string, target string, score double, rank int")
    assert {(r["source"], r["target"]) for r in semantic.mutual(g).collect()} == {("a", "b"), ("b", "a")}
    assert {(r["source"], r["target"]) for r in semantic.adaptive(g).collect()} == {("a", "b"), ("b", "a")}
    fused = semantic.fused([g, g.where("target <> 'c'")], 1).collect()
    assert {(r["source"], r["target"], r["score"]) for r in fused} == {("a", "b", 0.9), ("b", "a", 0.9)}
    titles = spark.createDataFrame([("a", "IO"), ("b", "IoT"), ("c", "Disks")], "id string, title string")
    assert {(r["source"], r["target"]) for r in semantic.gated(g, titles).collect()} == {("a", "c")}


def test_domain_relationships(spark):
    docs = spark.createDataFrame([("x", {"path": "/guides/x-one/"}), ("y", {}), ("z", {})], "id string, metadata map<string,string>")
    refs = relgraph.references(docs)
    rows = spark.createDataFrame([("/guides/x-one", "y", "editorial", 0.5, None), ("y", "z", "supersedes", None, "hand")], "source string, target string, type string, priority double, provenance string")
    got = {(r["source"], r["target"], r["type"], r["strength"]) for r in relgraph.compiled_domain(rows, refs).collect()}
    assert got == {("x", "y", "editorial", 0.5), ("y", "x", "editorial", 0.5), ("y", "z", "supersedes", 1.0)}
    with pytest.raises(InvalidArtifactError):
        relgraph.compiled_domain(spark.createDataFrame([("x", "gone", "supersedes", None, None)], rows.schema), refs)


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "a", 1)], "query_id string, id string, rank int")
    judged = spark.createDataFrame([("q", "a", 0), ("q", "b", 3), ("r", "a", 0), ("r", "b", 0)], "query_id string, id string, grade int")
    rows = {r["query_id"]: r for r in metrics.query_metrics(ranked, judged).collect()}
    assert abs(rows["q"]["ndcg_5"] - 0.63093) < 1e-4 and rows["q"]["mrr"] == 0.5 and rows["q"]["recall_5"] == 1.0
    assert rows["r"]["ndcg_5"] is None and rows["r"]["mrr"] is None
    with pytest.raises(InvalidArtifactError):
        metrics.check_judgments(judged, ranked.select("query_id").distinct(), spark.createDataFrame([("a",), ("b",), ("c",)], "id string"))


def test_rules_of_words(spark):
    pairs = [("cat", "cats", True), ("cache", "caching", True), ("query", "queries", True), ("scaled", "scaling", False), ("auth", "authentication", False), ("install", "installing", True), ("encrypt", "encryption", False)]
    rows = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select("a", "b", corpus.is_inflection(F.col("a"), F.col("b")).alias("x"), corpus.is_inflection(F.col("b"), F.col("a")).alias("y")).collect()
    assert {(r["a"], r["b"]): (r["x"], r["y"]) for r in rows} == {(a, b): (w, w) for a, b, w in pairs}
    counts = spark.createDataFrame([("auth", 4, 1), ("authentication", 5, 0), ("authorization", 5, 1), ("config", 3, 0), ("configuration", 3, 0), ("perf", 3, 1), ("performing", 9, 1), ("govern", 3, 1), ("governance", 2, 1)], "term string, df int, title_df int")
    assert {tuple(r) for r in corpus.alias_pairs(counts).collect()} == {("auth", "authentication")}
    terms = spark.createDataFrame([(t,) for t in ("s3", "k8s", "grpc", "utf8", "abc")], "t string").where(corpus.protected_literal(F.col("t"))).collect()
    assert {r["t"] for r in terms} == {"s3", "k8s", "grpc"}


def test_directional_relationships_go_one_way(spark):
    docs = spark.createDataFrame([("x", {}), ("y", {})], "id string, metadata map<string,string>")
    refs = relgraph.references(docs)
    rows = spark.createDataFrame([("x", "y", "editorial", None, None, True)], "source string, target string, type string, priority double, provenance string, directional boolean")
    assert [(r["source"], r["target"]) for r in relgraph.compiled_domain(rows, refs).collect()] == [("x", "y")]
    with pytest.raises(InvalidArtifactError):
        relgraph.compiled_domain(spark.createDataFrame([("x", "x", "editorial", None, None, None)], rows.schema), refs)
