"""Queries over whole documents against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from lexloom.functions.english import English
from lexloom.functions.text import tokenize
from lexloom.operators import semantic
from lexloom.plans import registry
from lexloom.plans.engine import SearchEngine

LINE = "A first line that every one of these documents has, in which nothing tells them apart at all"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents that are alike and unlike only past their 80th character, and items of many words."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    texts = [f"{LINE} {r.choice(words)}\n" + " ".join(r.choice(words) for _ in range(r.randint(5, 60))) for _ in range(40)]
    texts += [texts[3] + " more", "Another beginning, which is not like the others in any of its words or parts\n" + texts[7].split("\n")[1], "", None]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{at}/documents.parquet")
    items = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(6)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, texts, items


def cosine_graph(texts, k):
    """{(source, target, rank): score} by all pairs."""
    bags = {str(i): Counter(t for t in re.findall("[a-z0-9]+", (x or "").lower()) if t not in semantic.STOP and len(t) > 1) for i, x in enumerate(texts)}
    df = Counter(t for b in bags.values() for t in b)
    vectors = {}
    for i, b in bags.items():
        v = {t: n / sum(b.values()) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / norm for t, x in v.items()}
    out = {}
    for a, v in vectors.items():
        near = sorted((-round(s, 6), b) for b, w in vectors.items() if b != a and (s := sum(x * w.get(t, 0.0) for t, x in v.items())) > 0)
        out |= {(a, b, rank): -s for rank, (s, b) in enumerate(near[:k], 1)}
    return out


def test_text_neighbours_are_those_of_whole_texts(spark, tables):
    at, texts, _ = tables
    got = {(r["source"], r["target"], r["rank"]): r["score"] for r in registry.queries()["text_neighbours"](spark, at).collect()}
    want = cosine_graph(texts, 5)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    assert ("3", "40", 1) in got and ("41", "7", 1) in got


@pytest.mark.parametrize("block", [3, 16, 1024])
def test_blocks_give_one_graph(spark, tables, block):
    at, texts, _ = tables
    docs = semantic.prepared(registry.lines_view(spark, at), "whole")
    got = {(r["source"], r["target"], r["rank"]): r["score"] for r in semantic.lexical_graph(semantic.tfidf(docs), len(texts), 7, block=block).collect()}
    want = cosine_graph(texts, 7)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_every_word_of_an_item_is_scored(spark, tables):
    at, texts, items = tables
    fields = [(4.0, [tokenize((x or "").split("\n")[0]) for x in texts]), (1.0, [tokenize(x or "") for x in texts])]
    want = set()
    for item, text in items:
        total = Counter()
        for weight, docs in fields:
            mean = sum(map(len, docs)) / len(docs)
            for t in set(tokenize(text)):
                df = sum(t in d for d in docs)
                for i, d in enumerate(docs):
                    if tf := d.count(t):
                        total[str(i)] += weight * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        best = sorted((-round(s, 6), i) for i, s in total.items())[:5]
        want |= {(str(item), i, round(-s, 4), rn) for rn, (s, i) in enumerate(best, 1)}
    got = {(r["query_id"], r["id"], round(r["score"], 4), r["rn"]) for r in registry.queries()["search_bm25_whole"](spark, at).collect()}
    assert got == want


def test_first_lines_are_titles_to_their_end(spark, tables):
    at, texts, _ = tables
    titles = {t for x in texts for t in tokenize((x or "").split("\n")[0])}
    queries = registry.queries()
    found = {r["term"]: r["in_title"] for r in queries["index_vocabulary_of_lines"](spark, at).collect()}
    assert all(found[t] for t in titles) and found["apart"]
    df = {r["term"] for r in queries["document_frequencies_of_lines"](spark, at).where("field = 'title'").collect()}
    assert df == titles
    mined = {r["term"] for r in queries["mined_vocabulary_of_lines"](spark, at).where("kind = 'title'").collect()}
    assert texts[0].split("\n")[0].split()[-1] in mined


@pytest.mark.parametrize("name", [f.__name__ for f in registry._OF_LINES])
def test_queries_of_lines_give_rows_of_their_cut_query(spark, tables, name):
    at = tables[0]
    assert registry.queries()[name](spark, at).columns == registry.queries()[name.removesuffix("_of_lines")](spark, at).columns


def test_words_past_the_cut_are_suggested_and_begun(spark, tmp_path):
    line = "x" * 40 + " " + "y" * 30 + " completed words"
    spark.createDataFrame([(1, line + "\nbody")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "wordz compl")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    q = registry.queries()
    assert [(r["form"], r["suggestion"]) for r in q["typo_suggestions_of_lines"](spark, str(tmp_path)).where("form = 'wordz'").collect()] == [("wordz", "words")]
    assert [(r["form"], r["term"]) for r in q["prefix_matches_of_lines"](spark, str(tmp_path)).collect()] == [("compl", "completed")]


def test_ranked_documents_are_those_of_the_full_scan(spark, tables):
    at, _, items = tables
    engine = SearchEngine(spark, morphology=English())
    engine.index(registry.lines_view(spark, at))
    queries = spark.createDataFrame([(str(i), x) for i, x in items], "query_id string, raw string")
    of = lambda rows: sorted((r["query_id"], r["channel"], r["rank"], r["id"], round(r["score"], 6)) for r in rows.collect())
    want = of(engine.search_batch(queries))
    got = of(registry.queries()["ranked_documents"](spark, at))
    assert got == want and {x[0] for x in got} == {str(i) for i, _ in items}


def test_every_vector_of_a_label_is_followed(spark, tmp_path):
    vectors = [[1.0, 0.1 * i, 0.01 * i * i] for i in range(9)]
    spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    graph = {(r["source"], r["target"]) for r in registry.embedding_neighbours(spark, str(tmp_path)).collect()}
    got = {(r["query_id"], r["id"], r["sources"]) for r in registry.queries()["related_one_hop_whole"](spark, str(tmp_path)).collect()}
    assert got == {(label, t, len({s for s, x in graph if x == t and s % 2 == label})) for label in (0, 1) for _, t in graph if any(x == t and s % 2 == label for s, x in graph)}
