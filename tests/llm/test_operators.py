"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import decontamination, html_text, mixing, ngram_join, paragraph_dedup, pii, quality_rules, sharding, suffix_dedup, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, {} string"
R = random.Random(11)
VOCABULARY = ["".join(R.choice("aeioubcdfglmnprst") for _ in range(R.randint(2, 8))) for _ in range(900)]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def table(spark, texts, extra="curve", sources=("a", "b", None)):
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1]) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, sources[k % len(sources)], len(t) if t else None, "x") for k, (i, t) in enumerate(rows)], SCHEMA.format(extra))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    passage = prose(r, 70)
    base = [prose(r, 120) for _ in range(6)]
    edited = base[0].split()
    edited[7], edited[50] = "changed", "again"
    return [
        None, "", "   ", "one", *base, " ".join(edited), base[1], (5, base[1]), (5, base[1]), (None, base[2]), prose(r, 60) + "\n" + passage + "\n" + prose(r, 60), prose(r, 40) + "\n" + passage,
        "word " * 3000, prose(r, 9000), (7, prose(r, 30)), "x@y.com " + prose(r, 80),
    ]


ALL = {
    "quality": lambda d: quality_rules.quality_filter(d),
    "pii": lambda d: pii.pii_spans(d),
    "redact": lambda d: pii.redact(d),
    "tokens": lambda d: token_counts.with_token_counts(d),
    "shards": lambda d: sharding.hilbert_shards(d),
    "passages": lambda d: suffix_dedup.repeated_passages(d),
    "paragraphs": lambda d: paragraph_dedup.repeated_paragraphs(d),
    "mixing": lambda d: mixing.mixture(d),
    "decontamination": lambda d: decontamination.decontaminate(d, d.sparkSession.createDataFrame([(1, "nothing of the kind"), (2, None), (3, "")], "item_id bigint, text string")),
    "pairs": lambda d: ngram_join.near_copies(d),
    "near": lambda d: ngram_join.drop_near_copies(d),
    "html": lambda d: html_text.extracted(d, page="text"),
}


@pytest.mark.parametrize("name", ALL)
def test_an_empty_table_gives_an_empty_table(spark, name):
    assert ALL[name](table(spark, [])).count() == 0


@pytest.mark.parametrize(("name", "clash"), [(n, c) for n, c in (("quality", "_quality"), ("pii", "pii"), ("tokens", "n_tokens"), ("shards", "shard"), ("mixing", "copies"), ("decontamination", "hits"), ("near", "root"), ("html", "main"), ("passages", "gram"), ("paragraphs", "key"), ("pairs", "path"), ("redact", "kind"))])
def test_odd_rows_and_clashing_columns(spark, texts, name, clash):
    rows = ALL[name](table(spark, texts, extra=clash))
    rows.collect()
    if name in ("quality", "mixing", "decontamination", "near"):
        own = table(spark, [], extra=clash).columns
        assert [c for c in rows.columns if c in own] == own


def test_quality(spark, texts):
    judged = {(r["text"] or "")[:20]: r["quality"]["reason"] for r in quality_rules.compression_verdicts(table(spark, texts)).collect()}
    assert judged[""] == "empty" and judged["word " * 4] == "repetitive" and judged[texts[4][:20]] is None
    import base64
    import os

    noise = base64.b85encode(os.urandom(6000)).decode()
    mixed = "\n".join([prose(random.Random(2), 900), "spam " * 1200, prose(random.Random(3), 900)])
    found = {r["doc_id"]: r["quality"]["reason"] for r in quality_rules.compression_verdicts(table(spark, [noise, mixed])).collect()}
    assert found == {0: "incompressible", 1: "repetitive"}


def test_token_counts_equal_whole_encoding(spark, texts):
    e = token_counts.encoder(token_counts.VOCABULARY)
    for r in token_counts.with_token_counts(table(spark, texts), split_chars=300, batch_bytes=1000).collect():
        assert r["n_tokens"] == (None if r["text"] is None else len(e.encode_ordinary(r["text"])))


def test_pii_equals_the_parser_and_redacts(spark, texts):
    a = pii.automaton()
    for r in pii.pii_spans(table(spark, texts)).collect():
        assert [(s["kind"], s["start"], s["stop"]) for s in r["pii"]] == pii.find(r["text"] or "", a)
    assert any((r["text"] or "").startswith("<email> ") for r in pii.redact(table(spark, texts)).collect())


def test_shards_are_runs_of_the_curve(spark, texts):
    rows = sharding.hilbert_shards(table(spark, texts), shard_bytes=2000).collect()
    assert len(rows) == len(texts)
    order = sorted(rows, key=lambda r: (r["curve"], r["doc_id"] is not None, r["doc_id"] or 0))
    sizes, before = {}, 0
    for r in order:
        key = (r["curve"], r["doc_id"])
        sizes.setdefault(key, before)
        before += len((r["text"] or "").encode())
    assert all(r["shard"] == sizes[(r["curve"], r["doc_id"])] // 2000 for r in rows)
    assert len({r["shard"] for r in rows}) > 3


def windows(text, n):
    ws = (text or "").split()
    return [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]


def test_passages_equal_brute_force(spark, texts):
    n, gram = 12, 4
    docs = set((r["doc_id"], r["text"]) for r in table(spark, texts).collect())
    holders = defaultdict(set)
    for d in docs:
        for w in windows(d[1], n):
            holders[w].add(d)
    want = Counter()
    for d in docs:
        hit = [i for i, w in enumerate(windows(d[1], n)) if len(holders[w]) > 1]
        spans = []
        for i in hit:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + n
            else:
                spans.append([i, i + n])
        want.update((d[0], a, b) for a, b in spans)
    for block in (50, 1 << 18):
        got = Counter((r["doc_id"], r["start_word"], r["stop_word"]) for r in suffix_dedup.repeated_passages(table(spark, texts), length=n, gram=gram, block_words=block).collect())
        assert got == want and want


def test_paragraph_clusters_equal_brute_force(spark):
    r = random.Random(4)
    base = [prose(r, r.randint(20, 60)) for _ in range(12)]

    def near(t, k):
        ws = t.split()
        for _ in range(k):
            ws[r.randrange(len(ws))] = "zz" + str(r.random())
        return " ".join(ws)

    docs = ["\n".join(near(t, r.choice((0, 0, 1, 2))) for t in r.sample(base, 4)) for _ in range(30)] + [base[0], base[0]]
    rows = paragraph_dedup.repeated_paragraphs(table(spark, docs), span=0).collect()
    parts = [(i, k, p) for i, t in enumerate(docs) for k, p in enumerate(t.split("\n"))]
    grams = [{tuple(p.split()[j : j + 3]) for j in range(len(p.split()) - 2)} for _, _, p in parts]
    root = list(range(len(parts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(parts)):
        for b in range(a):
            if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= paragraph_dedup.THRESHOLD:
                root[find(a)] = find(b)
    groups = defaultdict(set)
    for i, (d, k, _) in enumerate(parts):
        groups[find(i)].add((d, k))
    want = {frozenset(g) for g in groups.values() if len({d for d, _ in g}) > 1}
    got = defaultdict(set)
    for x in rows:
        got[x["cluster"]].add((x["doc_id"], x["paragraph"]))
    assert {frozenset(g) for g in got.values()} == want
    assert all(sum(not x["remove"] for x in rows if x["cluster"] == c) == 1 for c in got)


def test_copies_add_up(spark):
    r = random.Random(6)
    docs = [(i, prose(r, 30)) for i in range(400)] + [(3, "same words here")] * 3
    for block in (16, 1 << 16):
        rows = mixing.with_copies(table(spark, docs), weights={"a": 2.0, "b": 1.0}, block_units=block).collect()
        assert len(rows) == len(docs)
        by = defaultdict(list)
        for x in rows:
            by[x["source"]].append(x)
        total = sum(len(x["text"]) for x in rows)
        for s, w in (("a", 2 / 3), ("b", 1 / 3), (None, 0.0)):
            rate = w * total / sum(len(x["text"]) for x in by[s])
            assert abs(sum(x["copies"] for x in by[s]) - rate * len(by[s])) < 1 + 1e-6
            assert all(x["copies"] in (int(rate), int(rate) + 1) for x in by[s])
    again = mixing.with_copies(table(spark, docs), weights={"a": 2.0, "b": 1.0}, block_units=1 << 16).collect()
    assert sorted((x["doc_id"], x["copies"]) for x in again) == sorted((x["doc_id"], x["copies"]) for x in rows)
    assert mixing.mixture(table(spark, docs), weights={"a": 2.0, "b": 1.0}).count() == sum(x["copies"] for x in rows)


def test_benchmark_hits_in_rounds(spark, texts):
    r = random.Random(8)
    items = [(i, prose(r, 20)) for i in range(8)] + [(1, None), (2, "")]
    docs = texts + [prose(r, 30) + " " + items[0][1].upper() + " " + prose(r, 30), items[3][1][:60] + "x" + items[3][1][61:]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(x["doc_id"], h["item_id"], h["distance"]) for x in decontamination.benchmark_hits(table(spark, docs), bench).collect() for h in x["hits"]}
    assert whole == {(len(docs) - 2, 0, 0), (len(docs) - 1, 3, 1)}
    parts = {(x["doc_id"], h["item_id"], h["distance"]) for x in decontamination.benchmark_hits(table(spark, docs), bench, chunk_chars=200).collect() for h in x["hits"]}
    assert parts == whole
    assert decontamination.decontaminate(table(spark, docs), bench).count() == len(docs) - 2


def jaccard(a, b, n=3):
    def grams(t):
        ws = t.lower().split()
        return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def near_copies():
    r = random.Random(9)
    out = []
    for _ in range(60):
        base = prose(r, r.randint(20, 150))
        out.append(base)
        for _ in range(r.choice((0, 1, 3))):
            ws = base.split()
            for _ in range(r.randint(0, len(ws) // 12)):
                ws[r.randrange(len(ws))] = "zz" + str(r.random())
            out.append(" ".join(ws))
    return out


def classes_by_hand(texts, threshold=ngram_join.THRESHOLD):
    """doc: (class, copies, links) of the texts, numbered from 0, by comparing all pairs."""
    grams = [frozenset(tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))) for ws in (t.lower().split() for t in texts)]
    root, links = list(range(len(texts))), defaultdict(set)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                if grams[a] != grams[b]:
                    links[a].add(grams[b]), links[b].add(grams[a])
    same = Counter(grams)
    return {i: (find(i), same[grams[i]] - 1, len(links[i])) for i in range(len(texts)) if same[grams[i]] > 1 or links[i]}


@pytest.mark.parametrize("options", [{}, {"small": 2}, {"small": 2, "depth": 1, "block": 4}, {"block": 3}])
def test_classes_and_links_against_brute_force(spark, near_copies, options):
    want = classes_by_hand(near_copies)
    got = {x["doc_id"]: (x["class_id"], x["copies"], x["links"]) for x in ngram_join.near_copies(table(spark, near_copies, extra="root"), **options).collect()}
    assert got.keys() <= want.keys() and len(got) >= 0.97 * len(want)
    assert all(got[i][1] == want[i][1] and got[i][2] <= want[i][2] for i in got)
    assert sum(x[2] for x in got.values()) >= 0.95 * sum(x[2] for x in want.values())
    assert sum(got[i][0] == want[i][0] for i in got) >= 0.95 * len(got)


def test_a_large_group_of_near_copies_keeps_all_links(spark):
    r = random.Random(21)
    base = prose(r, 80).split()
    docs = [" ".join([*base[:k % 80], "new" + str(k), *base[k % 80 + 1 :]]) for k in range(150)] + [" ".join(base)] * 3
    rows = ngram_join.near_copies(table(spark, docs), small=8, block=40).collect()
    assert len(rows) == 153 and {x["class_id"] for x in rows} == {0}
    assert all(x["links"] == 150 for x in rows)


def test_the_sketch_filter_is_within_the_recall():
    for c in (16, 32, 64, 128):
        k = ngram_join.least_equal(0.5, c, 3e-4)
        draws = np.random.default_rng(c).binomial(c, 0.5, 400_000)
        assert (draws < k).mean() < 4.5e-4 and k >= 1


def test_one_of_each_group_stays(spark, near_copies):
    docs = [*near_copies, None, "", "  ", (None, "alone " + near_copies[0] + " extra")] + [(2, near_copies[2])] * 2
    kept = ngram_join.drop_near_copies(table(spark, docs))
    rows = kept.collect()
    assert kept.columns == table(spark, []).columns
    left = [x["text"] for x in rows if (x["text"] or "").strip()]
    assert sum(jaccard(a, b) >= ngram_join.THRESHOLD for i, a in enumerate(left) for b in left[:i]) <= 1
    assert sum(not (x["text"] or "").strip() for x in rows) == 3
    lone = {near_copies[i] for i in range(len(near_copies)) if all(jaccard(near_copies[i], t) < 0.5 for j, t in enumerate(near_copies) if j != i)}
    assert lone - set(left) <= {near_copies[0]}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    got = {x["node"]: x["root"] for x in ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    assert all(got.get(x, x) == want[x] for x in want)


def test_html_null_pages(spark):
    rows = html_text.extracted(spark.createDataFrame([(1, None), (2, ""), (3, "<p>hi</p>")], "page_id bigint, html string")).orderBy("page_id").collect()
    assert [x["main"]["text"] for x in rows] == ["", "", "hi"]


def test_pipeline_keeps_clean_documents(spark, tmp_path, texts):
    import corpus_pipeline

    r = random.Random(12)
    items = [(i, prose(r, 25)) for i in range(3)]
    clean = [(i, prose(r, 80)) for i in range(100, 160)]
    docs = table(spark, [*texts, *clean, (200, "a " + items[0][1])])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        after = stage(spark, before, str(tmp_path))
        assert after.columns == before.columns
        ids = {x["doc_id"] for x in after.select("doc_id").collect()}
        assert {i for i, _ in clean} <= ids
        assert k < 2 or 200 not in ids
        before = after
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"curve", "shard"} <= set(out.columns) and out.where(F.col("doc_id") == 200).count() == 0 and out.count() > 20
