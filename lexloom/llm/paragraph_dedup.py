"""Substring dedup by paragraphs: MinHash bands bring paragraphs together, exact Jaccard verifies, components cluster.

A paragraph is a line of enough words. As passages are also pasted into the middle of lines, or run over several,
stretches of SPAN words are paragraphs too, begun where the text itself says: at the least gram of every REACH grams.
So a passage of REACH + SPAN words that two documents share has a stretch that both cut alike, wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, buffers, discard, distinct, hash_grams, hash_words, mix, row_key, words, written
from lexloom.llm.ngram_join import SEEDS, components
from lexloom.llm.suffix_dedup import sliding_min

LEAST_WORDS = 20
GRAM = 3
THRESHOLD = 0.7
#: 14 bands of 4: a pair of lines at the threshold collides with a chance of 0.98.
BANDS = 14
ROWS = 4
#: Words of a stretch, and grams of which the least begins one: every passage of SPAN + REACH words or more has one whole.
SPAN = 20
REACH = 30
#: Bands of a stretch: equal ones always collide, those at the threshold with a chance of 0.67; a passage has several.
SPAN_BANDS = 4
#: Bytes of text whose words are hashed at once.
CHUNK = 1 << 18
#: Keys that a task keeps, so as not to send the bands of one paragraph again and again.
SEEN = 1 << 20
#: Grams of buckets that are compared at once, or of one bucket if that has more; and of pairs that are compared at once.
HELD = 1 << 19
#: Paragraphs that a rare gram must have for one of them, in each of so many rounds, to be compared with the others first.
MANY = 16
ROUNDS = 2
_PLACE = pa.schema([("rk", pa.int64()), ("doc_id", pa.int64()), ("paragraph", pa.int32()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("key", pa.int64())])
_PLACE_KIND = "rk bigint, doc_id bigint, paragraph int, start_word int, n_words int, key bigint"


def minwise_rows(h: np.ndarray, edges: np.ndarray, gram: int, n: int) -> np.ndarray:
    """n minwise hashes of each run [edges[2k], edges[2k + 1]) of words, for all runs of a text at once."""
    begin, end = edges[::2], edges[1::2]
    size = np.maximum(end - begin - gram + 1, 1)
    grams = hash_grams(h, gram)
    flat = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    g = mix((grams[np.minimum(flat, len(grams) - 1)] >> np.uint64(32)) + np.uint64(0x9E3779B97F4A7C15))
    a, b = SEEDS[:n] | np.uint64(1), SEEDS[512 : 512 + n]
    start = np.cumsum(size) - size
    out = np.empty((n, len(size)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out[j] = np.minimum.reduceat(g * a[j] + b[j], start)
    return (out.T >> np.uint64(32)).astype(np.uint32)


def grams_of(h: np.ndarray, gram: int) -> np.ndarray:
    return distinct((hash_grams(h, min(gram, len(h))) >> np.uint64(32)).astype(np.uint32))


def anchors(h: np.ndarray, owner: np.ndarray, gram: int, reach: int, span: int) -> np.ndarray:
    """Where stretches of span words begin: the first least gram of every `reach` grams of one text (owner tells texts apart)."""
    grams = hash_grams(h, gram)
    if len(grams) < reach:
        return np.zeros(0, np.int64)
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((mix(grams) >> np.uint64(32) << np.uint64(32)) | place, reach)
    inside = owner[: len(least)] == owner[reach + gram - 2 :][: len(least)]
    at = np.unique((least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    at = at[at + span <= len(h)]
    return at[owner[at] == owner[at + span - 1]]


def cut(texts: list[bytes], least_words: int, gram: int, span: int, reach: int) -> tuple[np.ndarray, ...]:
    """Word hashes in lower case of some texts, and (text, line, first word in all and in its text, words) of each paragraph,
    first lines, then stretches; the number of lines among them comes last."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    start, end = words(data)
    h = hash_words(data, start, end, LOWER)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    breaks = np.flatnonzero(data == 10)
    first_word, first_line = np.searchsorted(start, begin), np.searchsorted(breaks, begin)
    edge = np.concatenate(([0], np.searchsorted(start, breaks), [len(start)]))
    line = np.flatnonzero(np.diff(edge) >= least_words)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(first_word, len(start))))
    at = anchors(h, owner, gram, reach, span) if span else np.zeros(0, np.int64)
    # In a run of equal words every stretch is the same: one of those that overlap is enough.
    if len(at) > 1:
        key = run_keys(h, np.column_stack((at, at + span)).ravel())
        at = at[np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] - at[:-1] >= span)))]
    lines = len(line)
    place = np.concatenate((edge[line], at)).astype(np.int64)
    size = np.concatenate((edge[line + 1] - edge[line], np.full(len(at), span))).astype(np.int64)
    text = owner[place] if len(place) else np.zeros(0, np.int64)
    number = np.searchsorted(breaks, start[place]) - first_line[text] if len(place) else place
    return h, text, number, place, place - first_word[text], size, lines


def run_keys(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words of each run."""
    begin, end = edges[::2], edges[1::2]
    size = end - begin
    start = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(start, size)
    with np.errstate(over="ignore"):
        terms = h[place + np.repeat(begin, size)] * mix(place.astype(np.uint64) + np.uint64(1))
        return mix(np.add.reduceat(terms, start) + size.astype(np.uint64)).view(np.int64)


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key of each band of each row of minwise hashes."""
    m = mins.reshape(len(mins), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            out = mix(out ^ m[:, :, r])
    return out.view(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows of a batch with their texts, some at a time; a long text alone."""
    offsets, data = buffers(batch.column("text"))
    rows, texts, held = [], [], 0
    for i in range(len(batch)):
        if offsets[i] == offsets[i + 1]:
            continue
        rows.append(i), texts.append(data[offsets[i] : offsets[i + 1]].tobytes())
        held += len(texts[-1])
        if held >= CHUNK:
            yield rows, texts
            rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def _places(least_words: int, gram: int, span: int, reach: int):
    """The paragraphs of each text."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in _chunks(batch):
                h, text, number, place, start, size, _ = cut(texts, least_words, gram, span, reach)
                if len(place):
                    keys = run_keys(h, np.column_stack((place, place + size)).ravel())
                    r = pa.array(np.array(own, np.int64)[text])
                    yield pa.RecordBatch.from_arrays([batch.column("rk").take(r), batch.column("doc_id").cast(pa.int64()).take(r), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(keys, pa.int64())], schema=_PLACE)

    return places


def _bands(least_words: int, gram: int, bands: int, rows: int, span: int, reach: int, span_bands: int):
    """(key, band) of the paragraphs; of those equal in a task only of the first, or of some where there are very many."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in _chunks(batch):
                h, _, _, place, _, size, lines = cut(texts, least_words, gram, span, reach)
                if not len(place):
                    continue
                keys = run_keys(h, np.column_stack((place, place + size)).ravel())
                if len(seen) > SEEN:
                    seen.clear()
                new = np.zeros(len(keys), bool)
                for i, k in enumerate(keys.tolist()):
                    if k not in seen:
                        seen.add(k)
                        new[i] = True
                for some, n in ((np.flatnonzero(new[:lines]), bands), (np.flatnonzero(new[lines:]) + lines, span_bands)):
                    if len(some):
                        own = band_keys(minwise_rows(h, np.column_stack((place[some], place[some] + size[some])).ravel(), min(gram, least_words), n * rows), n, rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[some], n)), pa.array(own.ravel())], ["key", "band"])

    return keyed


def _grams(gram: int):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            wanted = batch.column("wanted")
            edge, own = wanted.offsets.to_numpy(), wanted.values
            place, size, key = (own.field(c).to_numpy(zero_copy_only=False) for c in ("start_word", "n_words", "key"))
            parts, lengths = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]]
                h = hash_words(text, *words(text), LOWER)
                here = slice(edge[i], edge[i + 1])
                n = np.maximum(size[here] - gram + 1, 1).astype(np.int64)
                flat = np.repeat(place[here] - np.cumsum(n) + n, n) + np.arange(n.sum())
                each = (hash_grams(h, min(gram, len(h))) >> np.uint64(32))[flat]
                unique = distinct((np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32)) | each)
                lengths.append(np.bincount((unique >> np.uint64(32)).astype(np.int64), minlength=len(n)))
                parts.append(unique.astype(np.uint32).view(np.int32))
            sets = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(lengths)), pa.int32()), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([pa.array(key[edge[0] : edge[-1]]), sets], ["key", "grams"])

    return grams


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their exact Jaccard similarity."""
    a, b = sets.withColumnsRenamed({"key": "a", "grams": "ga"}), sets.withColumnsRenamed({"key": "b", "grams": "gb"})
    common = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(a, "a").join(b, "b").withColumn("jaccard", common / (F.size("ga") + F.size("gb") - common)).drop("ga", "gb")


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the least place of its component, once the places a are joined with b."""
    label = label.copy()
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def joined_within(bucket: np.ndarray, like: np.ndarray, size: np.ndarray, grams: np.ndarray, threshold: float) -> np.ndarray:
    """The least place of the component of each paragraph, as if all pairs of each bucket had been compared.

    bucket numbers each paragraph's bucket, size its grams, which `grams` has one set after the other; those of a bucket
    that are like its hub are joined from the start. A pair at the threshold shares one of the rarest grams of both (prefix
    filter): of the larger set the first size - threshold x size + 1, of the smaller fewer still. Paragraphs that share only
    what the whole bucket has in common never meet, and those that are joined already aren't compared again.
    """
    n = len(size)
    owner, start, label = np.repeat(np.arange(n), size), np.cumsum(size) - size, np.arange(n)
    liked = np.flatnonzero(like)
    _, first, of = np.unique(bucket[liked], return_index=True, return_inverse=True)
    label[liked] = liked[first][of]
    _, gram, count = np.unique(bucket[owner].astype(np.uint64) << np.uint64(32) | grams, return_inverse=True, return_counts=True)
    gram = gram[np.lexsort((gram, count[gram], owner))]
    place = np.arange(len(gram)) - start[owner]
    probed, indexed = (size - np.ceil(share * size - 1e-9).astype(np.int64) + 1 for share in (threshold, 2 * threshold / (1 + threshold)))
    at = np.flatnonzero((place < probed[owner]) & (count[gram] > 1))
    at = at[np.argsort(gram[at], kind="stable")]
    row, short = owner[at], place[at] < indexed[owner[at]]
    # Lists of the paragraphs that have a gram among their rarest.
    _, number = np.unique(gram[at], return_inverse=True)
    begin = np.searchsorted(number, np.arange(number[-1] + 2 if len(number) else 1))

    def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """label once those of the pairs (a, b) that are alike are joined."""
        open_pairs = (label[a] != label[b]) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9)
        pair = np.unique(np.minimum(a, b)[open_pairs] * n + np.maximum(a, b)[open_pairs])
        a, b = pair // n, pair % n
        done = np.cumsum(size[a] + size[b])
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + HELD, "right")))
            both = np.concatenate((a[lo:hi], b[lo:hi]))
            k = size[both]
            where = np.arange(k.sum()) + np.repeat(start[both] - np.cumsum(k) + k, k)
            each = np.repeat(np.tile(np.arange(hi - lo, dtype=np.uint64), 2), k) << np.uint64(32) | gram[where].astype(np.uint64)
            each.sort()
            common = np.bincount((each[1:][each[1:] == each[:-1]] >> np.uint64(32)).astype(np.int64), minlength=hi - lo)
            alike = common / (k[: hi - lo] + k[hi - lo :] - common) >= threshold
            label = join_labels(label, a[lo:hi][alike], b[lo:hi][alike])
            lo = hi
        return label

    shorts = np.flatnonzero(short)
    edge = np.searchsorted(number[shorts], np.arange(len(begin)))
    for turn in range(ROUNDS):
        many = np.flatnonzero((np.diff(begin) >= MANY) & (np.diff(edge) > 0))
        if len(many):
            chosen = row[shorts[edge[many] + mix(many.astype(np.uint64) + np.uint64(turn << 32)).astype(np.int64) % np.diff(edge)[many]]]
            length = np.diff(begin)[many]
            others = row[np.arange(length.sum()) + np.repeat(begin[many] - np.cumsum(length) + length, length)]
            label = joined(label, np.repeat(chosen, length), others)
    # What is left are pairs of one list and different components, which lie together in it.
    by = np.lexsort((label[row], number))
    row, short, number = row[by], short[by], number[by]
    new = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (label[row][1:] != label[row][:-1])))) if len(row) else number
    block = np.searchsorted(new, np.arange(len(row)), "right")
    ends = np.append(new, len(row))
    shorts = np.flatnonzero(short)
    lows = np.concatenate((begin[number[shorts]], ends[block[shorts]]))
    length = np.concatenate((new[block[shorts] - 1], begin[number[shorts] + 1])) - lows
    own = np.concatenate((row[shorts], row[shorts]))
    lows, length, own = lows[length > 0], length[length > 0], own[length > 0]
    done = np.cumsum(length)
    lo = 0
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + HELD, "right")))
        k = length[lo:hi]
        a, b = np.repeat(own[lo:hi], k), row[np.arange(k.sum()) + np.repeat(lows[lo:hi] - np.cumsum(k) + k, k)]
        larger = (size[b] > size[a]) | (size[b] == size[a]) & (b > a)
        label = joined(label, a[larger], b[larger])
        lo = hi
    return label


def _joined(threshold: float):
    """Links (a, b) that join the like paragraphs of each bucket of a partition that is sorted by band."""

    def links(bands: pa.Table) -> pa.RecordBatch:
        band, key = (bands.column(c).to_numpy() for c in ("band", "key"))
        sets = bands.column("grams").combine_chunks()
        bucket = np.cumsum(np.concatenate(([0], band[1:] != band[:-1])))
        size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        label = joined_within(bucket, bands.column("like").to_numpy(), size, sets.flatten().to_numpy().view(np.uint32), threshold)
        other = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(key[label[other]]), pa.array(key[other])], ["a", "b"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grams = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            grams += len(batch.column("grams").flatten())
            if grams >= HELD:
                table = pa.Table.from_batches(held)
                band = table.column("band").to_numpy()
                whole = int(np.searchsorted(band, band[-1]))
                if whole:
                    yield links(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
                    grams = sum(len(b.column("grams").flatten()) for b in held)
        if held:
            yield links(pa.Table.from_batches(held))

    return joined


def repeated_paragraphs(docs: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, gram: int = GRAM, bands: int = BANDS, rows: int = ROWS, span: int = SPAN, reach: int = REACH, span_bands: int = SPAN_BANDS) -> DataFrame:
    """(doc_id, paragraph, start_word, n_words, cluster, first_doc_id, remove): the paragraphs that have a like in another document.

    Paragraphs are the lines of least_words words or more, and stretches of span words (none if span is 0), which begin where
    the text says and may lie within a line or run over several; so a passage of span + reach words or more that two
    documents share is found wherever it stands. `paragraph` is the line, from 0, that it begins in, start_word its first word
    in the text. Two are alike if the Jaccard similarity of their word n-grams is the threshold or more; clusters are the
    components; all but the first of a cluster (least id, then place) are to be removed. Shorter lines are no paragraphs
    of their own: they are covered by the stretches that run over them.

    In a band's bucket each paragraph is compared with the least one; where some are unlike it, the bucket's gram sets go to
    one task, which compares those that share a rare gram and aren't joined yet, so clusters are as if all pairs had been
    compared, while what moves follows the paragraphs and not their pairs. Equal paragraphs count once there. Texts that are null or empty have no
    paragraphs; rows that repeat id and text are one document, reported once; a null id sorts last; texts are read whole;
    an empty table gives an empty one.
    """
    keyed = docs.select(row_key().alias("rk"), "doc_id", "text")
    by_band = Window.partitionBy("band")
    in_bands = docs.select("text").mapInArrow(_bands(least_words, gram, bands, rows, span, reach, span_bands), "key bigint, band bigint").withColumn("hub", F.min("key").over(by_band)).withColumn("last", F.max("key").over(by_band))
    colliding = written(in_bands.where("hub != last").select("band", "hub", "key").distinct(), "collisions")
    places = written(keyed.mapInArrow(_places(least_words, gram, span, reach), _PLACE_KIND), "paragraphs")
    # Of each key that collides or that two documents have: the documents' least and greatest, and where its words stand.
    at = F.shiftleft(F.col("start_word").cast("bigint"), 32) + F.col("n_words")
    each = places.groupBy("key").agg(F.min("rk").alias("lo"), F.max("rk").alias("hi"), F.min_by(at, "rk").alias("at"))
    some = colliding.select("key").distinct().withColumn("collides", F.lit(True))
    keys = written(each.join(some, "key", "left").where("collides or lo != hi"), "keys")
    place = F.struct(F.shiftright("at", 32).cast("int").alias("start_word"), (F.col("at") % F.lit(1 << 32)).cast("int").alias("n_words"), "key")
    wanted = keys.where("collides").groupBy(F.col("lo").alias("rk")).agg(F.collect_list(place).alias("wanted"))
    sets = written(keyed.join(wanted, "rk").select("text", "wanted").mapInArrow(_grams(gram), "key bigint, grams array<int>").dropDuplicates(["key"]), "grams")
    to_hub = written(_verified(colliding.where("key != hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct(), sets), "to-hub")
    near = F.col("jaccard") >= threshold
    rows_of = colliding.join(to_hub.select(F.col("a").alias("hub"), F.col("b").alias("key"), near.alias("like")), ["hub", "key"]).select("band", "key", "like")
    unsettled = rows_of.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bool_and("like").alias("settled")).where("n > 1 and not settled").select("band")
    in_buckets = rows_of.join(unsettled, "band").join(sets, "key").repartition("band").sortWithinPartitions("band")
    edges = to_hub.where(near).select("a", "b").unionByName(in_buckets.mapInArrow(_joined(threshold), "a bigint, b bigint"))
    joined = components(edges)
    roots = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    discard(colliding, sets, to_hub)
    clustered = keys.select("key", "lo", "hi").join(roots, keys["key"] == roots["node"], "left").where("node is not null or lo != hi").select("key", F.coalesce("root", "key").alias("cluster"))
    found = written(places.select("rk", "doc_id", "paragraph", "start_word", "n_words", "key").join(clustered, "key").drop("key").dropDuplicates(["rk", "doc_id", "start_word", "n_words"]), "found")
    discard(places, keys)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start_word", "n_words", "rk")).alias("first")
    clusters = found.groupBy("cluster").agg(F.min("rk").alias("lo"), F.max("rk").alias("hi"), first).where("lo != hi").select("cluster", "first")
    out = found.join(clusters, "cluster")
    keeps = (F.col("rk") == F.col("first.rk")) & (F.col("start_word") == F.col("first.start_word")) & (F.col("n_words") == F.col("first.n_words"))
    return out.select("doc_id", "paragraph", "start_word", "n_words", "cluster", F.col("first.doc_id").alias("first_doc_id"), (~keeps).alias("remove"))
