"""Benchmark decontamination: pigeonhole pieces found by one automaton, Myers' bit-parallel distance to verify."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import discard, fresh, written

#: Edits allowed by characters of an item, and characters that a piece has at least.
RATE = 0.1
LEAST_PIECE = 10
#: Characters of items whose automaton is sent to every worker; more items are searched in several rounds.
CHUNK_CHARS = 8 << 20
KIND = "array<struct<item_id:bigint,distance:int,ends:int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("ends", pa.int32())]))


def normalise(text: str) -> str:
    """Lower case, with runs of white space as one space."""
    return " ".join(text.lower().split())


def budget_of(n: int, rate: float = RATE, least_piece: int = LEAST_PIECE) -> int:
    return max(0, min(int(n * rate), n // least_piece - 1))


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces of about equal length: any match with that many edits holds one of them whole."""
    n, k = len(item), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(pattern: str, text: str, budget: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the closest substring of text, the first of equals; None if it needs more than budget edits."""
    m = len(pattern)
    if not m:
        return None
    masks = masks_of(pattern) if masks is None else masks
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = (mh << 1 & full) | (full & ~(xv | ph))
        mv = ph & xv & full
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


def anchored(masks: dict[str, int], m: int, text: str, budget: int) -> int:
    """The least distance of a pattern of m characters from any beginning of text; more than budget where it exceeds it."""
    if not m:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 | 1
        pv = (mh << 1 & full) | (full & ~(xv | ph))
        mv = ph & xv & full
    return best


class Item:
    """A benchmark item, its budget, and the parts beside each piece that an alignment must get through within it."""

    __slots__ = ("id", "text", "budget", "masks", "beside")

    def __init__(self, item_id: int, text: str, budget: int) -> None:
        self.id, self.text, self.budget, self.masks = item_id, text, budget, masks_of(text)
        self.beside: dict[int, tuple] = {}

    def parts(self, at: int, n: int) -> tuple:
        """(masks, length, forward) of what stands after and before the piece, the longer first, cut where random text has
        used up the budget."""
        if at not in self.beside:
            reach = 2 * self.budget + 8
            after, before = self.text[at + n : at + n + reach], self.text[:at][::-1][:reach]
            both = [(masks_of(after), len(after), True), (masks_of(before), len(before), False)]
            self.beside[at] = tuple(sorted(both, key=lambda x: -x[1]))
        return self.beside[at]

    def may_match(self, t: str, start: int, at: int, n: int) -> bool:
        """False only if no alignment with the piece at `at` found at t[start:] stays within the budget: the distances of the
        parts beside it are a lower bound, as a match is anchored at the piece on either side."""
        left = self.budget
        for masks, m, forward in self.parts(at, n):
            reach = m + left
            side = t[start + n : start + n + reach] if forward else t[max(0, start - reach) : start][::-1]
            left -= anchored(masks, m, side, left)
            if left < 0:
                return False
        return True


class Pieces:
    """The automaton of all pieces and, for each place of a piece in an item, what stands beside it."""

    #: Characters beside a piece that are compared at once, one bit for each.
    WIDTH = 63

    def __init__(self, owners: dict[str, list[tuple[int, int]]], known: list[Item]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        counts, item, at, size = [], [], [], []
        for k, (piece, own) in enumerate(owners.items()):
            self.automaton.add_word(piece, k)
            counts.append(len(own))
            for i, a in own:
                item.append(i), at.append(a), size.append(len(piece))
        if owners:
            self.automaton.make_automaton()
        self.first = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
        self.item, self.at, self.size = (np.array(x, np.int64) for x in (item, at, size))
        self.budget = np.array([known[i].budget for i in item], np.int64)
        self.forward = np.zeros(len(item), bool)
        self.m = np.zeros(len(item), np.int64)
        self.beside = np.zeros((len(item), self.WIDTH + 1), np.uint8)
        for j, (i, a, n) in enumerate(zip(item, at, size)):
            it = known[i]
            after, before = it.text[a + n : a + n + 2 * it.budget + 8], it.text[max(0, a - 2 * it.budget - 8) : a][::-1]
            self.forward[j] = len(after) >= len(before)
            part = letters(after if self.forward[j] else before)[: self.WIDTH]
            self.m[j] = len(part)
            self.beside[j, : len(part)] = part

    def __bool__(self) -> bool:
        return len(self.item) > 0

    def likely(self, flat: np.ndarray, start: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which places `start` of pieces in the text can belong to a match: the bit-parallel distance of what stands on the
        longer side of the piece, for many places at once. Letters are compared by one byte, so no match is refused."""
        keep = np.ones(len(start), bool)
        order = np.argsort(self.m[owner] + self.budget[owner], kind="stable")
        for c in range(0, len(order), 2048):
            at = order[c : c + 2048]
            own = owner[at]
            m, budget = self.m[own], self.budget[own]
            some = m > budget
            at, own, m, budget = at[some], own[some], m[some], budget[some]
            if not len(at):
                continue
            sign = np.where(self.forward[own], 1, -1)
            place = np.where(self.forward[own], start[at] + self.size[own], start[at] - 1)
            beside = self.beside[own]
            one, n = np.uint64(1), m.astype(np.uint64)
            full, top = (one << n) - one, n - one
            pv, mv, score, best = full.copy(), np.zeros(len(at), np.uint64), m.copy(), m.copy()
            for _ in range(int((m + budget).max())):
                letter = flat[np.clip(place, 0, len(flat) - 1)]
                place = place + sign
                eq = np.packbits(beside == letter[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0] & full
                xv = eq | mv
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph = mv | (full & ~(xh | pv))
                mh = pv & xh
                score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
                np.minimum(best, score, out=best)
                ph = ph << one | one
                pv = (mh << one & full) | (full & ~(xv | ph))
                mv = ph & xv & full
            keep[at] = best <= budget
        return keep


def letters(text: str) -> np.ndarray:
    """A byte from 1 on for each character; different characters may have the same."""
    return (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % np.uint32(251) + np.uint32(1)).astype(np.uint8)


def build(items: Iterable[tuple[int, str]], rate: float = RATE, least_piece: int = LEAST_PIECE):
    """The pieces of all items and what is needed of each item; items shorter than a piece are left out."""
    known, owners = [], {}
    for item_id, text in items:
        t = normalise(text or "")
        if len(t) < max(1, least_piece):
            continue
        k = budget_of(len(t), rate, least_piece)
        for at, piece in pieces_of(t, k):
            owners.setdefault(piece, []).append((len(known), at))
        known.append(Item(item_id, t, k))
    return Pieces(owners, known), known


def find_all(texts: list[str | None], pieces: Pieces, known: list[Item]) -> list[list[tuple[int, int, int]]]:
    """For each text (item, distance, end in the normalised text) of the closest match of each item found in it."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not pieces:
        return out
    held: list[tuple[int, str, list]] = []
    chars = 0
    for i, text in enumerate(texts):
        t = normalise(text) if text else ""
        events = list(pieces.automaton.iter(t)) if t else []
        if events:
            held.append((i, t, events))
            chars += len(t)
        if held and (chars > 1 << 20 or i == len(texts) - 1):
            _verify(held, pieces, known, out)
            held, chars = [], 0
    if held:
        _verify(held, pieces, known, out)
    return out


def _verify(held: list[tuple[int, str, list]], pieces: Pieces, known: list[Item], out: list[list[tuple[int, int, int]]]) -> None:
    gap = 2 * (pieces.WIDTH + 1) + int(pieces.budget.max(initial=0))
    flat = np.zeros(sum(len(t) for _, t, _ in held) + gap * (len(held) + 1), np.uint8)
    base, at = [], gap
    for _, t, _ in held:
        flat[at : at + len(t)] = letters(t)
        base.append(at)
        at += len(t) + gap
    hit = np.array([e for _, _, events in held for e in events], np.int64)
    text = np.repeat(np.arange(len(held)), [len(events) for _, _, events in held])
    n = pieces.first[hit[:, 1] + 1] - pieces.first[hit[:, 1]]
    owner = np.repeat(pieces.first[hit[:, 1]] - np.cumsum(n) + n, n) + np.arange(n.sum())
    text, end = np.repeat(text, n), np.repeat(hit[:, 0], n)
    start = end - pieces.size[owner] + 1
    keep = pieces.likely(flat, start + np.array(base)[text], owner)
    spans: dict[int, dict[int, list[list[int]]]] = {}
    for k, s, o in zip(text[keep].tolist(), start[keep].tolist(), owner[keep].tolist()):
        item, a0 = int(pieces.item[o]), int(pieces.at[o])
        it = known[item]
        if not it.may_match(held[k][1], s, a0, int(pieces.size[o])):
            continue
        a = s - a0 - it.budget
        b = a + len(it.text) + 2 * it.budget
        places = spans.setdefault(k, {}).setdefault(item, [])
        if places and a <= places[-1][1] and b >= places[-1][0]:
            places[-1][0], places[-1][1] = min(a, places[-1][0]), max(b, places[-1][1])
        else:
            places.append([a, b])
    for k, own in spans.items():
        i, t, _ = held[k]
        for item, places in own.items():
            it, best = known[item], None
            for a, b in places:
                a = max(0, a)
                match = myers(it.text, t[a:b], it.budget, it.masks)
                if match and (best is None or (match[0], a + match[1]) < best):
                    best = (match[0], a + match[1])
            if best:
                out[i].append((it.id, *best))
        out[i].sort()


def find(text: str | None, pieces: Pieces, known: list[Item]) -> list[tuple[int, int, int]]:
    return find_all([text], pieces, known)[0]


#: The pieces that this worker built last; those of a round before are given up.
_built: dict = {}


def _finder(sent, key: str, rate: float, least_piece: int):
    def hits(text: pa.Array) -> pa.Array:
        if key not in _built:
            _built.clear()
            _built[key] = build(sent.value, rate, least_piece)
        found = find_all(text.to_pylist(), *_built[key])
        return pa.array([[{"item_id": i, "distance": d, "ends": e} for i, d, e in own] for own in found], _ARROW)

    return hits


def too_short(benchmark: DataFrame, least_piece: int = LEAST_PIECE) -> DataFrame:
    """The items of the benchmark that benchmark_hits doesn't look for, as they have fewer characters than a piece (or none)."""
    return benchmark.where(F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))) < max(1, least_piece))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, out: str = "hits", rate: float = RATE, least_piece: int = LEAST_PIECE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """docs with `out`, the items that each text holds: item_id, distance, and where the closest match ends.

    An item of n characters (after normalise) is held by a text if a substring is within int(n * rate) edits of it,
    or fewer where pieces would get shorter than least_piece; every item so held is reported once, with its closest match.
    Items shorter than least_piece are not looked for, as a few characters occur anywhere; too_short() lists them.
    Items or texts that are null or empty match nothing; items that repeat are reported each; rows that repeat are searched
    each; texts are searched whole; an empty table stays empty and an empty benchmark gives no hits.

    A benchmark of more than chunk_chars characters is searched in rounds, each a job of its own whose hits are written to
    the shared folder; neither driver nor worker holds more than one round's items. A column named `out` is replaced, other
    columns stay.
    """
    total = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    rounds = max(1, -(-total // chunk_chars))
    context = docs.sparkSession.sparkContext

    def send(part: DataFrame):
        return context.broadcast([(r["item_id"], r["text"]) for r in part.select("item_id", "text").toLocalIterator()])

    if rounds == 1:
        return docs.withColumn(out, F.arrow_udf(_finder(send(benchmark), uuid.uuid4().hex, rate, least_piece), KIND)(F.col("text")))
    base = docs.drop(out)
    key, other = fresh(base, "row", "found")
    texts, parts = base.select("text").where("text is not null").select(F.xxhash64("text").alias("row"), "text").dropDuplicates(["row", "text"]), []
    for i in range(rounds):
        sent = send(benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == i))
        found = texts.withColumn("hits", F.arrow_udf(_finder(sent, uuid.uuid4().hex, rate, least_piece), KIND)(F.col("text"))).where("size(hits) > 0")
        parts.append(written(found, f"hits-{i}"))
        sent.destroy()
    each = parts[0]
    for part in parts[1:]:
        each = each.unionByName(part)
    whole = written(each.groupBy("row", "text").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits")), "hits")
    discard(*parts)
    whole = whole.select(F.col("row").alias(key), F.col("text").alias(other), F.col("hits").alias(other + "_hits"))
    joined = base.join(whole, (F.xxhash64(base["text"]) == whole[key]) & (base["text"] == whole[other]), "left")
    return joined.select(*[base[c] for c in base.columns], F.coalesce(F.col(other + "_hits"), F.array().cast(KIND)).alias(out))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item of the benchmark, with their own columns, whatever their names.

    Rows with null or empty texts hold none and stay; rows that repeat all stay or all go; empty tables stay empty.
    """
    (name,) = fresh(docs, "hits")
    return benchmark_hits(docs, benchmark, out=name, **options).where(F.size(name) == 0).drop(name)
