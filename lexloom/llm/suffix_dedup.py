"""Suffix-array dedup: passages that documents share, from two-stage suffix sorting of what can repeat.

A passage counts from LENGTH words. Windows of that many words are routed by their least word-gram, so equal windows meet
in one task; only grams that two documents hold go on, runs of windows with one gram travel as one stretch of
words, and equal stretches travel once. Each task sorts the suffixes of its stretches: those smaller than their
successors directly, the rest induced by one scan over the buckets; adjacent common prefixes then show what repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import _BASE, buffers, hash_grams, hash_words, mix, row_key, words, written

LENGTH = 50
GRAM = 8
#: Words that one suffix array covers, unless the stretches of a single gram are more.
BLOCK_WORDS = 1 << 18
_RUN = pa.schema([("rk", pa.int64()), ("doc_id", pa.int64()), ("gram", pa.int64()), ("stretch", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
_RUN_KIND = "rk bigint, doc_id bigint, gram bigint, stretch bigint, at int, n int"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs_of(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least gram, first window, windows) of each run of neighbouring windows with one least gram."""
    least = sliding_min(hash_grams(h, gram), length - gram + 1)
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    return least[first], first, np.diff(np.append(first, len(least)))


def stretch_keys(h: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the words that each run of windows covers."""
    with np.errstate(over="ignore"):
        step = np.uint64(_BASE)
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(h), step, np.uint64))), dtype=np.uint64)
        inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(h), np.uint64(pow(_BASE, -1, 1 << 64)), np.uint64))), dtype=np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers[:-1], dtype=np.uint64)))
        size = n + length - 1
        return mix((sums[first + size] - sums[first]) * inverse[first] + size.astype(np.uint64))


def _runs(length: int, gram: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            rows, out = [], [[], [], [], []]
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]]
                h = hash_words(text, *words(text))
                if len(h) < length:
                    continue
                least, first, n = runs_of(h, length, gram)
                rows.append(np.full(len(first), i))
                for held, x in zip(out, (least, stretch_keys(h, first, n, length), first, n)):
                    held.append(x)
            if rows:
                row = pa.array(np.concatenate(rows))
                least, key, first, n = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([batch.column("rk").take(row), batch.column("doc_id").cast(pa.int64()).take(row), pa.array(least.view(np.int64)), pa.array(key.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], schema=_RUN)

    return runs


_STRETCH = pa.schema([("gram", pa.int64()), ("stretch", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("first", pa.int64()), ("words", pa.binary())])
_STRETCH_KIND = "gram bigint, stretch bigint, least bigint, most bigint, first bigint, words binary"


def _stretches(length: int):
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            wanted, rows = batch.column("wanted").to_pylist(), []
            for i, own in enumerate(wanted):
                text = data[offsets[i] : offsets[i + 1]]
                h = (hash_words(text, *words(text)) >> np.uint64(32)).astype(np.uint32)
                rows.extend((w["gram"], w["stretch"], w["least"], w["most"], w["first"], h[w["at"] : w["at"] + w["n"] + length - 1].tobytes()) for w in own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _STRETCH)], schema=_STRETCH)

    return stretches


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of t in order, compared up to depth words or the next 0, which ends each stretch (the last of all too).

    Suffixes smaller than their successors are sorted directly; every other one goes to the next place of its first
    word's bucket when the scan from the left meets its successor.
    """
    n = len(t)
    after = np.append(t[1:], 0)
    differs = np.where(t != after, np.arange(n), n)
    decides = np.minimum(np.minimum.accumulate(differs[::-1])[::-1], n - 1)
    small = t[decides] < after[decides]
    small[-1] = True
    to_end = np.flatnonzero(t == 0)
    left = to_end[np.searchsorted(to_end, np.arange(n))] - np.arange(n)
    direct = np.flatnonzero(small)
    kind = np.dtype(">u2") if t.max(initial=0) < 65536 else np.dtype(">u4")
    padded = np.append(t, np.zeros(depth, t.dtype)).astype(kind)
    keys = np.empty(len(direct), f"S{depth * kind.itemsize}")
    reach = np.arange(depth)
    for i in range(0, len(direct), 1 << 14):
        at = direct[i : i + (1 << 14)]
        rows = padded[at[:, None] + reach]
        rows[reach >= left[at, None]] = 0
        keys[i : i + (1 << 14)] = rows.view(keys.dtype)[:, 0]
    direct = direct[np.argsort(keys, kind="stable")]
    counts = np.bincount(t)
    ends = np.cumsum(counts)
    heads = (ends - counts).tolist()
    per = np.bincount(t[direct], minlength=len(counts))
    order = np.full(n, -1, np.int64)
    first = t[direct]
    order[(ends - per)[first] + np.arange(len(direct)) - (np.cumsum(per) - per)[first]] = direct
    places, of, induced = order.tolist(), t.tolist(), (~small).tolist()
    for p in range(n):
        j = places[p] - 1
        if j >= 0 and induced[j]:
            c = of[j]
            places[heads[c]] = j
            heads[c] += 1
    return np.array(places, np.int64)


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Words that neighbours in the order have in common, up to depth or the end of a stretch."""
    out = np.zeros(len(order) - 1, np.int64)
    live = np.arange(len(order) - 1)
    a, b = order[:-1], order[1:]
    for _ in range(depth):
        x = t[a]
        go = (x == t[b]) & (x != 0)
        live, a, b = live[go], a[go] + 1, b[go] + 1
        if not len(live):
            break
        out[live] += 1
    return out


def repeated_runs(stretches: list[np.ndarray], least: np.ndarray, most: np.ndarray, first: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(stretch, first window, last window + 1, least document) of the windows that two documents hold.

    least and most are the least and greatest row keys that hold a stretch, first its least document.
    """
    sizes = np.array([len(s) for s in stretches])
    flat = np.concatenate(stretches)
    _, ids = np.unique(flat, return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    t = np.zeros(int((sizes + 1).sum()), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    mask = np.ones(len(t), bool)
    mask[begin + sizes] = False
    t[mask] = ids + 1
    order = suffix_order(t, length)
    same = common_prefixes(t, order, length) >= length
    whole = (begin + sizes)[owner[order]] - order >= length
    group = np.cumsum(np.concatenate(([True], ~same))) - 1
    order, group = order[whole], group[whole]
    if not len(order):
        return []
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    own = owner[order]
    lo, hi, doc = np.minimum.reduceat(least[own], start), np.maximum.reduceat(most[own], start), np.minimum.reduceat(first[own], start)
    size = np.diff(np.append(start, len(order)))
    shared = np.repeat(lo != hi, size)
    at, doc = order[shared], np.repeat(doc, size)[shared]
    by = np.argsort(at)
    at, doc = at[by], doc[by]
    if not len(at):
        return []
    o = owner[at]
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (o[1:] != o[:-1]))))
    end = np.append(cut[1:], len(at)) - 1
    return [(int(o[i]), int(at[i] - begin[o[i]]), int(at[j] - begin[o[j]]) + 1, int(doc[i])) for i, j in zip(cut, end)]


_FOUND = pa.schema([("stretch", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("first", pa.int64())])


def _sorted_blocks(length: int, block_words: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        total, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 0:
                keys, least, most, first, parts = zip(*held)
                found = repeated_runs(list(parts), np.array(least), np.array(most), np.array(first), length)
                if found:
                    s, lo, hi, doc = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in s], pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(doc, pa.int64())], schema=_FOUND)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gram", "stretch", "least", "most", "first", "words")]
            for gram, *row in zip(*columns):
                if total >= block_words and gram != last:
                    yield from flush()
                    held, total = [], 0
                part = np.frombuffer(row[-1], np.uint32)
                held.append((*row[:-1], part))
                total += len(part) + 1
                last = gram
        yield from flush()

    return blocks


NO_ID = -(1 << 63)


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, start_word, stop_word, first_doc_id): the maximal stretches of each document, in words parted by white
    space, every window of `length` words of which is found in another document too; first_doc_id is the least id holding a
    part of it (the document's own where it is the first).

    Documents are told apart by id and text: rows that repeat both are one and are reported once, rows with one id
    and different texts are two. A null id counts as a document, reported as null. Texts that are null or shorter than
    `length` words hold no passage. Words are compared by 64-bit hashes.
    """
    keyed = docs.select(row_key().alias("rk"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text")
    runs = written(keyed.mapInArrow(_runs(length, gram), _RUN_KIND), "runs")
    shared = runs.groupBy("gram").agg(F.min("rk").alias("a"), F.max("rk").alias("b")).where("a != b").select("gram")
    places = written(runs.join(shared, "gram", "left_semi"), "places")
    each = places.groupBy("gram", "stretch").agg(F.min("rk").alias("least"), F.max("rk").alias("most"), F.min("doc_id").alias("first"), F.min(F.struct("rk", "at", "n")).alias("p"))
    wanted = each.groupBy(F.col("p.rk").alias("rk")).agg(F.collect_list(F.struct("gram", "stretch", "least", "most", "first", "p.at", "p.n")).alias("wanted"))
    held = keyed.join(wanted, "rk").select("text", "wanted").mapInArrow(_stretches(length), _STRETCH_KIND)
    one = held.repartition("gram").sortWithinPartitions("gram", "stretch").mapInArrow(_sorted_blocks(length, block_words), "stretch bigint, lo int, hi int, first bigint")
    spans = places.join(one, "stretch").select("rk", "doc_id", (F.col("at") + F.col("lo")).alias("a"), (F.col("at") + F.col("hi") + F.lit(length - 1)).alias("b"), "first").distinct()
    by = Window.partitionBy("rk").orderBy("a", "b")
    reach = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", (reach.isNull() | (F.col("a") > reach)).cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy("rk", "doc_id", "island").agg(F.min("a").alias("start_word"), F.max("b").alias("stop_word"), F.min("first").alias("first_doc_id"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(named("doc_id"), "start_word", "stop_word", named("first_doc_id"))
