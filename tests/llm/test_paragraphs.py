"""Passages in the middle of lines and over several of them, and stretches against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from lexloom.llm import paragraph_dedup

R = random.Random(77)
WORDS = ["".join(R.choice("aeioubcdfglmnprst") for _ in range(R.randint(2, 8))) for _ in range(700)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_pasted_passages_are_found_and_clean_ones_left_alone(spark):
    r = random.Random(1)
    passages = [prose(r, r.randint(50, 70)) for _ in range(10)]
    broken = [p.split() for p in passages]
    holders = [f"{prose(r, r.randint(0, 60))} {p} {prose(r, r.randint(0, 60))}" for p in passages for _ in range(3)]
    holders += [prose(r, 12) + " " + "\n".join(" ".join(p[i : i + 9]) for i in range(0, len(p), 9)) for p in broken]
    clean = [prose(r, 150) for _ in range(40)]
    rows = paragraph_dedup.repeated_paragraphs(table(spark, [*holders, *clean, None, "", "a"])).collect()
    assert {x["doc_id"] for x in rows} == set(range(40))
    for x in rows:
        ws = [*holders, *clean][x["doc_id"]].split()
        assert x["start_word"] + x["n_words"] <= len(ws)
    assert {c: sum(not x["remove"] for x in rows if x["cluster"] == c) for c in {x["cluster"] for x in rows}} == {x["cluster"]: 1 for x in rows}


def test_stretches_equal_brute_force(spark):
    r = random.Random(2)
    passages = [prose(r, 60) for _ in range(5)]
    texts = [f"{prose(r, 30)} {r.choice(passages)} {prose(r, 30)}" for _ in range(24)] + ["same " * 90, "same " * 70]
    options = {"least_words": 999, "threshold": 0.8, "span_bands": 40, "rows": 2}
    got = {(x["doc_id"], x["start_word"], x["cluster"]) for x in paragraph_dedup.repeated_paragraphs(table(spark, texts), **options).collect()}
    parts = []
    for i, t in enumerate(texts):
        starts = paragraph_dedup.cut([t.encode()], 999, 3, paragraph_dedup.SPAN, paragraph_dedup.REACH)[4]
        parts += [(i, int(s), {tuple(t.split()[j : j + 3]) for j in range(s, s + paragraph_dedup.SPAN - 2)}) for s in starts]
    root = np.arange(len(parts))
    for a in range(len(parts)):
        for b in range(a):
            if len(parts[a][2] & parts[b][2]) / len(parts[a][2] | parts[b][2]) >= 0.8:
                root[root == root[a]] = root[b]
    groups, clusters = defaultdict(set), defaultdict(set)
    for (i, s, _), c in zip(parts, root.tolist()):
        groups[c].add((i, s))
    for i, s, c in got:
        clusters[c].add((i, s))
    got, want = {frozenset(g) for g in clusters.values()}, {frozenset(g) for g in groups.values() if len({i for i, _ in g}) > 1}
    assert got == want


def brute_components(sets, threshold):
    root = np.arange(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                root[root == max(root[a], root[b])] = min(root[a], root[b])
    return root.tolist()


def test_components_of_buckets_equal_brute_force(monkeypatch):
    r = random.Random(3)
    for held, many, threshold in [(5, 1, 0.7), (1 << 19, 16, 0.7), (40, 3, 0.6), (1 << 19, 2, 1.0), (300, 16, 0.5)] * 3:
        monkeypatch.setattr(paragraph_dedup, "HELD", held), monkeypatch.setattr(paragraph_dedup, "MANY", many)
        bucket, like, sets = [], [], []
        for i in range(5):
            core, rest = r.sample(range(1 << 32), r.randint(0, 18)), r.sample(range(1 << 32), 30)
            for _ in range(r.randint(1, 40)):
                bucket.append(i), like.append(r.random() < 0.2)
                sets.append({*r.sample(core, len(core) * r.choice([8, 9, 10]) // 10), *r.sample(rest, r.randint(1, 9))})
        marked = [{(b, g) for g in s} for b, s in zip(bucket, sets)]
        want = brute_components(marked, threshold)
        for b in set(bucket):  # those like the hub are joined from the start
            ours = [want[i] for i in range(len(sets)) if bucket[i] == b and like[i]]
            want = [min(ours) if w in ours else w for w in want]
        size, grams = np.array([len(s) for s in sets]), np.array([g for s in sets for g in s], np.uint32)
        assert paragraph_dedup.joined_within(np.array(bucket), np.array(like), size, grams, threshold).tolist() == want
    none = np.zeros(0, np.int64)
    assert not len(paragraph_dedup.joined_within(none, none.astype(bool), none, none.astype(np.uint32), 0.7))


def most_rows(spark, since):
    """The most rows that one node of a plan gave in queries after that number."""
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


def test_a_common_sentence_makes_no_pairs_of_all_that_hold_it(spark):
    """Stretches around one sentence meet in one bucket: work follows their number, and those that are alike are still found."""
    r = random.Random(4)
    sentence, n = prose(r, 12), 700
    texts = [f"{prose(r, 30)} {sentence} {prose(r, 30)}" for _ in range(n)]
    for i in range(0, 40, 2):  # one word away from the sentence differs
        ws = texts[i].split()
        ws[48] = "changed"
        texts[i + 1] = " ".join(ws)
    spark.range(1).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    since = max(e.executionId() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.sharedState().statusStore().executionsList()))
    got = {(x["doc_id"], x["start_word"], x["cluster"]) for x in paragraph_dedup.repeated_paragraphs(table(spark, texts), least_words=999, span_bands=30, rows=2).collect()}
    rows = most_rows(spark, since)
    parts = []
    for i, t in enumerate(texts):
        for s in paragraph_dedup.cut([t.encode()], 999, 3, paragraph_dedup.SPAN, paragraph_dedup.REACH)[4].tolist():
            parts.append((i, s, {tuple(t.split()[j : j + 3]) for j in range(s, s + paragraph_dedup.SPAN - 2)}))
    assert 0 < rows <= 60 * len(parts)  # 30 bands for each, in and out; all pairs would be n * n / 2 in each of several bands
    groups, clusters = defaultdict(set), defaultdict(set)
    for (i, s, _), c in zip(parts, brute_components([p[2] for p in parts], paragraph_dedup.THRESHOLD)):
        groups[c].add((i, s))
    for i, s, c in got:
        clusters[c].add((i, s))
    want = {frozenset(g) for g in groups.values() if len({i for i, _ in g}) > 1}
    assert len(want) >= 20 and {frozenset(g) for g in clusters.values()} == want
