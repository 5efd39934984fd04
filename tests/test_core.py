"""Text rules, morphology, query analysis and ranking without Spark or on a few rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexloom.errors import InvalidArtifactError, InvalidConfigError, InvalidSchemaError, NotIndexedError
from lexloom.functions import text as T
from lexloom.functions import versions as V
from lexloom.functions.english import English, strip_suffix, suffix_stripped
from lexloom.operators import ranking
from lexloom.operators.analysis import Analyzer, looks_like_junk, typo_forms
from lexloom.operators.analysis import Lexicon
from lexloom.operators.dictionary import Dictionary, Synonyms
from lexloom.plans.engine import SearchEngine, fields

WORDS = ["Shards", "learning", "hello-World_x", "It's 'quoted' \"x\"", "a*b c", "TLS 1.2 & AES-128", "cooool", "coool!!!", "éABC", "", None, "recursively libraries", "dating related class bus ties ties"]


def column(spark, values, fn, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(fn(F.col("x"))).collect()]


def test_tokens_agree(spark):
    assert column(spark, WORDS, T.tokens) == [T.tokenize(w) for w in WORDS]
    assert T.tokenize("It's a C++/Rust_x 1.2*") == ["its", "a", "c", "rust", "x", "1", "2*"]


def test_morphology_agrees(spark):
    english = English({"mice": "mouse", "shards": "other"})
    words = sorted({t for w in WORDS for t in T.tokenize(w)} | {"mice", "mices", "shardsss", "sharding", "application", "kubernetes", "operating", "used", "bed", "sing", "ies", "parties", "glass", "ion", "million"})
    assert column(spark, words, english.lemma_column) == [english.lemma(w) for w in words]
    assert column(spark, words, english.canonical_column) == [english.canonical_lemma(w) for w in words]
    assert column(spark, words, suffix_stripped) == [strip_suffix(w) for w in words]
    assert english.lemma("shards") == "shard" and english.lemma("operating") == "operate" and english.canonical_lemma("kubernetes") is None


def test_prefixes_agree(spark):
    pairs = [(q, t) for q in ("mon", "mono", "io", "a", "12", "", "monoto") for t in ("mono", "monotonic", "iot", "123", "mon", "")]
    rows = spark.createDataFrame(pairs, "q string, t string").select("q", "t", T.allow_prefix(F.col("q"), F.col("t")).alias("p")).collect()
    assert [r["p"] for r in rows] == [T.allows_prefix(*p) for p in pairs]


def test_versions(spark):
    assert V.spans_of("TLS 1.2 and 10.0.1, AES-128, v3.") == ["1.2", "10.0.1"]
    assert column(spark, ["TLS 1.2", "Chapter 1 and 2", "a1.2 b"], V.marked_tokens) == [["tls", "1" + V.MARK, "2" + V.MARK], ["chapter", "1", "and", "2"], ["a1" + V.MARK, "2" + V.MARK, "b"]]


def test_small_functions(spark):
    assert column(spark, ["sh4rd5", "123456", "h3llo", "plain1"], T.decode_leet) == ["shards", None, None, "plaini"]
    assert column(spark, [0, 1, 5, None], T.saturating, "int") == [0.0, 0.4094, 0.6418, 0.0]
    assert column(spark, [["a", "learn", "b"], [], ["x"]], lambda x: T.ngrams(x, 1, 2), "array<string>") == [["learn", "a learn", "learn b"], [], []]
    assert column(spark, [-1.0, 0.5, 7.0, float("nan"), None], T.clamp01, "double") == [0.0, 0.5, 1.0, 0.0, 0.0]
    assert column(spark, [" x﻿", " y ", None], T.canonical_id) == ["x", "y", ""]
    assert T.levenshtein("kitten", "sitting") == 3 and T.levenshtein("abc", "xyzabc", 2) == 3
    assert looks_like_junk("zzzz") and not looks_like_junk("planet")


def analyzer(words, entries=(), **options):
    return Analyzer(words, morphology=English(), dictionary=Dictionary(list(entries)), **options)


def test_typos_and_compounds():
    assert typo_forms("bluetoth", Lexicon({"bluetooth", "blue"})) == [("bluetooth", 1, "edit-distance")]
    a = analyzer({"machine", "learning", "bluetooth", "settings"})
    assert [t["normalized"] for t in a.analyse("machinelearning")["tokens"]] == ["machine", "learn"]
    assert a.analyse("bluetoth")["query_norm"] == "bluetooth"
    assert [t["sources"] for t in a.analyse("settingsss")["tokens"]] == [["surface", "repeat-collapse", "morphology"]]
    assert a.analyse("")["tokens"] == [] and a.analyse(None)["concepts"] == []


def test_completion():
    a = analyzer({"container", "containers", "continent"})
    one = a.analyse("the contai")
    assert one["completion"]["completed"] == "container" and not one["completion"]["ambiguous"]
    assert a.analyse("the conti")["query_norm"].endswith("continent")
    both = a.analyse("cont")
    assert both["completion"]["ambiguous"] and both["query_norm"] == "cont"


def test_configured_equivalences():
    ml = [{"key": "ML", "expansion": ["Machine", "Learning"]}]
    a = analyzer({"machine", "shop"}, ml)
    for q in ("ml", "machine learning", "machine learn"):
        found = a.analyse(q)
        assert [c["id"] for c in found["concepts"]] == ["ml"] and found["phrase_keys"] == ["machine learn"]
    pair = [{"key": "http", "expansion": ["hypertext", "transfer", "protocol"]}, {"key": "https", "expansion": ["hypertext", "transfer", "protocol", "secure"]}]
    assert [c["id"] for c in analyzer(set(), pair).analyse("hypertext transfer protocol secure")["concepts"]] == ["https"]
    same = [{"key": "aa", "expansion": ["x1", "y1"]}, {"key": "bb", "expansion": ["x1", "y1"]}]
    assert all(c["kind"] != "acronym" for c in analyzer(set(), same).analyse("x1 y1")["concepts"])
    syn = Analyzer({"car"}, synonyms=Synonyms([{"terms": ["car", "auto"]}, {"terms": ["one"]}]))
    assert syn.analyse("car")["concepts"][0]["forms"] == ["car", "auto"]


def test_order_of_a_cycle_and_ties():
    places, cycles = ranking.ordered(["a", "b", "c", "d"], [1.0, 2.0, 3.0, 9.0], [(0, 1), (1, 2), (2, 0), (0, 3)])
    assert [("a", "b", "c", "d")[p] for p in places] == ["c", "b", "a", "d"] and cycles == [["a", "b", "c"]]
    assert ranking.ordered(["b", "a"], [1.0, 1.0], [])[0] == [1, 0]
    n = 5000
    assert ranking.ordered([f"{i:05}" for i in range(n)], [0.0] * n, [(i + 1, i) for i in range(n - 1)])[0][0] == n - 1


def vector(qid, doc, **features):
    base = {"query_id": qid, "id": doc, "score": 0.0, "query_token_count": 1, "title_token_count": 3, "direct_class": "weak", "relevance": "direct", "equivalence": "", "version": ""}
    base |= dict.fromkeys(("exact_title", "exact_token", "typed_surface", "canonical_key", "short_lead", "span_component", "contextual_hit"), False)
    base |= dict.fromkeys(("query_coverage", "title_coverage", "prefix_quality", "contextual_quality", "phrase_count"), 0.0)
    return {**base, **features}


def test_constraints(spark):
    rows = [
        vector("exact", "a", exact_title=True), vector("exact", "b", query_coverage=1.0),
        vector("conflict", "a", version="dotted"), vector("conflict", "b", canonical_key=True),
        vector("weaker", "a", exact_title=True), vector("weaker", "b", version="dotted"),
        vector("none", "a"), vector("none", "b"),
        vector("tight", "a", query_coverage=1.0, title_coverage=0.9, title_token_count=4), vector("tight", "b", query_coverage=1.0, title_coverage=0.9, title_token_count=2),
        vector("related", "a", relevance="related"), vector("related", "b", exact_token=True, query_coverage=0.5),
    ]
    df = spark.createDataFrame(rows)
    got = {r["query_id"]: (r["order"], r["conflict"], r["resolution"]) for r in ranking.pair_decisions(df).collect()}
    assert got == {
        "exact": (-1, False, "constraint"), "conflict": (0, True, "unordered-same-class-conflict"), "weaker": (-1, True, "stronger-class-wins"), "none": (0, False, "unordered"),
        "tight": (1, False, "constraint"), "related": (1, False, "constraint"),
    }
    hybrid = {r["query_id"]: r["order"] for r in ranking.pair_decisions(df, ranking.HYBRID).collect()}
    assert hybrid["related"] == -1


def test_options(spark):
    for bad in ({"retriever": "nope"}, {"relationship_strategy": "nope"}, {"candidate_limit": 0}, {"retrieval_weight": -1}, {"unknown": 1}):
        with pytest.raises(InvalidConfigError):
            SearchEngine(spark, **bad)
    with pytest.raises(InvalidSchemaError):
        fields({"title": {"type": "number"}})
    assert fields({"name": {"type": "text"}, "t": {"type": "text", "role": "title"}}) == ("t", "name")
    with pytest.raises(NotIndexedError):
        SearchEngine(spark).search("x")


def test_artifacts(spark, tmp_path):
    from lexloom.sources import artifacts as A

    assert A.checked(None, A.SYNONYMS) is None
    for bad in ({}, {"format": A.SYNONYMS}, {"format": A.SYNONYMS, "version": 2}, []):
        with pytest.raises(InvalidArtifactError):
            A.checked(bad, A.SYNONYMS)
    graph = {"format": A.RELATIONSHIPS, "version": 1, "relationships": {"b": [{"target": "c", "strength": 2}, {"target": "a", "strength": "x"}], "__proto__": [{"target": "z"}]}}
    edges = A.relationships(spark, graph)
    assert [tuple(r)[:5] for r in edges.collect()] == [("b", 0, "c", "related", 1.0), ("b", 1, "a", "related", 0.0)]
    assert [e["target"] for e in A.relationships_artifact(edges)["relationships"]["b"]] == ["c", "a"]
    A.save(graph, tmp_path / "g.json")
    assert A.load(tmp_path / "g.json", A.RELATIONSHIPS) == graph
    (tmp_path / "c.json").write_text('{"documents": [{"id": "b", "title": "B", "content": "x"}, {"title": "A", "body": "y"}, {"body": "lost"}]}')
    assert [tuple(r) for r in A.corpus_documents(spark, str(tmp_path / "c.json")).collect()] == [("A", "A", "y"), ("b", "B", "x")]
