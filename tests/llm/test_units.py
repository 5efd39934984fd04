"""Parts of the operators without Spark, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import decontamination, html_text, mixing, ngram_join, paragraph_dedup, pii, sharding, suffix_dedup, token_counts
from lexloom.llm.common import hash_words, words


def edit_distance_within(p: str, t: str) -> int:
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


@given(st.text("ab", min_size=1, max_size=80), st.text("ab", max_size=90))
@settings(max_examples=150, deadline=None)
def test_myers_equals_dynamic_programming(p, t):
    hit = decontamination.myers(p, t, len(p))
    assert (hit[0] if hit else len(p)) == edit_distance_within(p, t)


def test_every_match_within_the_budget_is_found():
    r = random.Random(5)
    letters = "abcdefgh "
    items = [(i, "".join(r.choice(letters) for _ in range(r.randint(20, 120))).strip()) for i in range(12)]
    automaton, known = decontamination.build(items)
    for _ in range(150):
        _, t = r.choice(items)
        t = list(t)
        for _ in range(r.randint(0, 12)):
            t[r.randrange(len(t))] = r.choice(letters)
        text = "".join(r.choice(letters) for _ in range(50)) + "".join(t) + "".join(r.choice(letters) for _ in range(50))
        norm = decontamination.normalise(text)
        want = {x.id: edit_distance_within(x.text, norm) for x in known if edit_distance_within(x.text, norm) <= x.budget}
        assert {i: d for i, d, _ in decontamination.find(text, automaton, known)} == want


def test_words_and_hashes():
    data = np.frombuffer("ab  cd\tab\nçd ".encode(), np.uint8)
    start, end = words(data)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["ab", "cd", "ab", "çd"]
    h = hash_words(data, start, end)
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    long = np.frombuffer(b"w%d " * 1 + b"same " * 30000 + b"other", np.uint8)
    h = hash_words(long, *words(long))
    assert len(set(h.tolist())) == 3


@pytest.mark.parametrize("seed", range(60))
def test_suffix_sort_finds_all_repeated_windows(seed):
    r = np.random.default_rng(seed)
    length = int(r.integers(2, 6))
    stretches = [r.integers(1, 4, size=r.integers(length, 25)).astype(np.uint32) for _ in range(r.integers(1, 7))]
    keys = np.arange(len(stretches)) + 10
    got = {(s, w, d) for s, lo, hi, d in suffix_dedup.repeated_runs(stretches, keys, keys, keys, length) for w in range(lo, hi)}
    holders = defaultdict(set)
    for i, s in enumerate(stretches):
        for w in range(len(s) - length + 1):
            holders[tuple(s[w : w + length])].add(i + 10)
    want = {(i, w, min(holders[tuple(s[w : w + length])])) for i, s in enumerate(stretches) for w in range(len(s) - length + 1) if len(holders[tuple(s[w : w + length])]) > 1}
    assert got == want


def test_suffix_order_is_sorted():
    r = np.random.default_rng(1)
    t = r.integers(1, 4, size=400)
    t[::37] = 0
    t[-1] = 0
    order = suffix_dedup.suffix_order(t, 30)
    assert sorted(order) == list(range(len(t)))

    def key(i):
        s = t[i : i + 30].tolist()
        return s[: s.index(0)] if 0 in s else s

    assert all(key(a) <= key(b) for a, b in zip(order, order[1:]))


@given(st.lists(st.floats(0, 1), min_size=0, max_size=60), st.integers(0, 1000))
@settings(max_examples=150, deadline=None)
def test_pivotal_rounding_keeps_the_sum(parts, seed):
    out, held, p = mixing.pivotal_round(np.array(parts, float), np.random.default_rng(seed))
    assert set(out.tolist()) <= ({-1, 0, 1} if held >= 0 else {0, 1})
    assert (out == -1).sum() == (held >= 0)
    assert abs(sum(parts) - (out[out >= 0].sum() + p)) < 1e-6


def test_pivotal_rounding_keeps_each_probability():
    parts = np.array([0.2, 0.7, 0.5, 0.35, 0.9, 0.35])
    total = np.zeros(6)
    for seed in range(3000):
        rng = np.random.default_rng(seed)
        out, held, p = mixing.pivotal_round(parts, rng)
        if held >= 0:
            out[held] = rng.random() < p
        total += out
    assert np.abs(total / 3000 - parts).max() < 0.04


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (3, 3)])
def test_hilbert_neighbours_touch(n, bits):
    table = sharding.curve_table(n, bits)
    assert sorted(table) == list(range(len(table)))
    side = 1 << bits
    place = {v: [code >> bits * (n - 1 - d) & (side - 1) for d in range(n)] for code, v in enumerate(table)}
    assert all(sum(abs(a - b) for a, b in zip(place[i], place[i + 1])) == 1 for i in range(len(table) - 1))


def test_splitting_keeps_token_counts():
    e = token_counts.encoder(token_counts.VOCABULARY)
    r = random.Random(2)
    text = "".join(r.choice(["word", " ", "  ", "é", "9", "'s", "\n", " of the", "!?", "日本", "²"]) for _ in range(4000))
    for most in (5, 50, 999):
        parts = token_counts.split_safely(text, most)
        assert "".join(parts) == text and len(parts) > 1
        assert sum(len(e.encode_ordinary(p)) for p in parts) == len(e.encode_ordinary(text))


@pytest.mark.parametrize(("text", "want"), [
    ("write to Jo.Doe+x@sub.example.co.uk, now", [("email", "Jo.Doe+x@sub.example.co.uk")]),
    ("a@b @x.com foo@ x@@y.com", []),
    ("call +1 (714) 555-9345 or (555) 123-4567.", [("phone", "+1 (714) 555-9345"), ("phone", "(555) 123-4567")]),
    ("IBAN DE89 3704 0044 0532 0130 00 ok", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("card 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
    ("host 97.51.17.173, v1.2.3.4.5 and 300.1.1.1", [("ip", "97.51.17.173")]),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]),
    ("n 9807915762804490 x", [("account", "9807915762804490")]),
    ("at 12 Main Street now, 3 of 4", [("address", "12 Main Street")]),
    ("see https://a.example.com/x?q=1). and www.foo.org", [("url", "https://a.example.com/x?q=1"), ("url", "www.foo.org")]),
    ("account no: AB123456, the account of 1999", [("account", "AB123456")]),
    ("", []), ("İİİ x@y.com", [("email", "x@y.com")]),
])
def test_pii(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.find(text, pii.automaton())] == want


def test_html_extraction():
    body = "<p>" + "Long text of the article, with words. " * 10 + "</p>"
    page = f'<html><head><title>A &amp; B</title><style>p{{}}</style></head><body><nav><ul>{"<li><a href=x>menu</a></li>" * 20}</ul></nav><div id=m>{body * 4}<script>var t="</p>";</script></div><footer><a href=y>c</a> small</footer></body></html>'
    title, text, density = html_text.extract(page)
    assert title == "A & B" and density > 0
    assert text.count("Long text") == 40 and "menu" not in text and "var" not in text
    assert html_text.extract("") == ("", "", 0.0)
    assert html_text.extract("just words")[1] == "just words"
    assert html_text.extract("<p>unclosed <b>bold<p>second")[1] == "unclosed bold\nsecond"
    for broken in ("<", "<a", "<a href='", "</x>", "<!--", "<script>", "<![CDATA[x", "&#xZZ;", "<p" * 50, "<div>" * 3000 + "deep"):
        html_text.extract(broken)


def test_minwise_rows_equal_minwise():
    r = random.Random(3)
    texts = ["\n".join(" ".join(r.choice("abcdefg") * 2 for _ in range(r.randint(1, 40))) for _ in range(6)).encode() for _ in range(5)]
    h, text, number, place, start, size, lines = paragraph_dedup.cut(texts, 5, 3, 0, 0)
    want = [(i, k, len(x.split())) for i, t in enumerate(texts) for k, x in enumerate(t.split(b"\n")) if len(x.split()) >= 5]
    assert list(zip(text.tolist(), number.tolist(), size.tolist())) == want and lines == len(want)
    edges = np.column_stack((place, place + size)).ravel()
    rows, keys = paragraph_dedup.minwise_rows(h, edges, 3, 20), paragraph_dedup.run_keys(h, edges)
    for i, (a, n) in enumerate(zip(place, size)):
        assert (rows[i] == ngram_join.minwise(paragraph_dedup.grams_of(h[a : a + n], 3), 20)).all()
        assert keys[i] == paragraph_dedup.run_keys(h[a : a + n], np.array([0, n]))[0]


@pytest.mark.parametrize("seed", range(8))
def test_a_pasted_passage_has_a_stretch_cut_alike(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(paragraph_dedup.SPAN + paragraph_dedup.REACH)]
    if seed == 7:
        passage = ["same"] * len(passage)
    texts = [" ".join([word() for _ in range(r.randint(0, 90))] + passage + [word() for _ in range(r.randint(0, 90))]).encode() for _ in range(6)]
    alone = [paragraph_dedup.cut([t], 999, 3, 20, 30) for t in texts]
    keys = [set(paragraph_dedup.run_keys(x[0], np.column_stack((x[3], x[3] + x[5])).ravel()).tolist()) for x in alone]
    assert set.intersection(*keys)
    whole = paragraph_dedup.cut(texts, 999, 3, 20, 30)
    assert sorted(zip(whole[1].tolist(), whole[4].tolist())) == [(i, s) for i, x in enumerate(alone) for s in x[4].tolist()]


def test_similar_within_equals_brute_force():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, size=r.integers(5, 40))).astype(np.uint32) for _ in range(40)]
    got = ngram_join.similar_within(sets, 0.3)
    assert all(got[i, j] == (len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.3) for i in range(40) for j in range(40))


def test_components_within():
    r = np.random.default_rng(5)
    for _ in range(30):
        ok = r.random((30, 30)) < 0.03
        ok |= ok.T
        root = list(range(30))
        for _ in range(30):
            for i, j in zip(*np.nonzero(ok)):
                root[i] = root[j] = min(root[i], root[j])
        assert ngram_join.components_within(ok).tolist() == root


def test_zstandard_is_deterministic():
    assert zstandard.ZstdCompressor(level=3).compress(b"a" * 100) == zstandard.ZstdCompressor(level=3).compress(b"a" * 100)
