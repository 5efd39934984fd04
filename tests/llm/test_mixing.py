"""Mixing: units of one id and text in several sources, repeats, clashing columns, and the tree against a version by hand."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexloom.llm import mixing

CLASHES = ("counts", "_copies", "_rk", "_ord", "key", "unit", "place", "total", "file", "again")


def table(spark, rows):
    names = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, s, *(c for c in CLASHES)) for i, t, s in rows], f"doc_id bigint, text string, source string, {names}")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    text = lambda: "".join(r.choice("abc de") for _ in range(r.randint(1, 40)))
    return [(i, text(), r.choice("ab")) for i in range(90)] + [(500, "the very same", s) for s in ("a", "b", None)] + [(501, "again and again", "a")] * 7 + [(None, None, "a"), (None, "", None), (2, None, "b")]


def test_sources_dont_swap_copies_of_one_text(spark, rows):
    got = mixing.with_copies(table(spark, rows), weights={"a": 1.0}).collect()
    assert Counter((x["doc_id"], x["text"], x["source"]) for x in got) == Counter(rows)
    assert all(x["copies"] == 0 for x in got if x["source"] != "a")
    size = lambda s: sum(len(t or "") for _, t, o in rows if s is ... or o == s)
    rate = size(...) / size("a")
    own = [x["copies"] for x in got if x["source"] == "a"]
    assert abs(sum(own) - rate * len(own)) < 1 + 1e-6 and set(own) <= {int(rate), int(rate) + 1}
    repeats = [x["copies"] for x in got if x["doc_id"] == 501]
    assert len(repeats) == 7 and max(repeats) - min(repeats) <= 1 and abs(sum(repeats) - 7 * rate) < 1 + 1e-6


def test_columns_of_any_name_stay(spark, rows):
    docs = table(spark, rows)
    for got in (mixing.with_copies(docs), mixing.mixture(docs)):
        assert [c for c in got.columns if c != "copies"] == docs.columns
        assert all(x[c] == c for x in got.collect() for c in CLASHES)
    assert mixing.with_copies(docs.withColumnRenamed("counts", "copies")).columns.count("copies") == 1


def test_bad_weights_are_refused(spark, rows):
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.with_copies(table(spark, rows), weights={"a": bad})


def by_hand(units, blocks, seed, fan_in):
    """units {(source, block): [(rk, part)]} rounded pair by pair, level by level, in plain Python."""
    taken, level = {}, 0
    while True:
        last, up = blocks <= 1, defaultdict(list)
        for (source, block), own in units.items():
            rng = np.random.default_rng([seed, level, block, *(source.encode() if source is not None else (256,))])
            own = sorted(own)
            own = [own[i] for i in rng.permutation(len(own))]
            draws = rng.random(len(own))
            held = None
            for (rk, q), u in zip(own, draws):
                if q <= 1e-9 or q >= 1 - 1e-9:
                    taken[source, rk] = round(q)
                elif held is None:
                    held = (rk, q)
                else:
                    (other, p), s = held, held[1] + q
                    if s < 1 - 1e-9:
                        held, lost = ((other, s), rk) if u * s < p else ((rk, s), other)
                        taken[source, lost] = 0
                    elif s <= 1 + 1e-9:
                        taken[source, other], taken[source, rk], held = int(u < p), int(u >= p), None
                    else:
                        held, won = ((rk, s - 1), other) if u * (2 - s) < 1 - q else ((other, s - 1), rk)
                        taken[source, won] = 1
            if held and last:
                taken[source, held[0]] = int(rng.random() < held[1])
            elif held:
                up[source, block // fan_in].append(held)
        if last:
            return taken
        units, blocks, level = up, -(-blocks // fan_in), level + 1


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_the_tree_equals_one_by_hand(spark, blocks):
    r = random.Random(blocks)
    flat = [(r.choice(["a", "b", None]), r.randrange(blocks), rk, 1, 0, r.choice([0.0, 1.0, 0.5, 0.25, r.random()]), -1) for rk in range(200)]
    units = defaultdict(list)
    for s, b, rk, _, _, p, _ in flat:
        units[s, b].append((rk, p))
    got = mixing.round_units(spark.createDataFrame(flat, mixing._UNIT), blocks, seed=5, fan_in=2).collect()
    assert {(x["source"], x["rk"]): x["taken"] for x in got} == by_hand(units, blocks, 5, 2) and len(got) == 200
    for s in ("a", "b", None):
        assert abs(sum(x["taken"] for x in got if x["source"] == s) - sum(u[5] for u in flat if u[0] == s)) < 1
