"""N-gram Jaccard join by chosen paths: sets are split again and again on sampled shared tokens, small buckets are
compared by brute force, and runs repeat until the target recall."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, buffers, discard, distinct, fresh, hash_grams, hash_words, mix, row_key, words, written

GRAM = 3
THRESHOLD = 0.5
#: Coordinates of the embedding (minwise hashes) from which paths choose.
COORDINATES = 64
#: Chance that a pair at the threshold is compared, over all runs.
RECALL = 0.97
#: Buckets of so many sets are compared by brute force. Larger ones are split, unless the split before took less than half of
#: the sets away (sets that are nearly equal can't be parted), and as often as depth_for says; what is larger then is
#: compared by brute force all the same, in blocks, each pair of blocks in a task's turn.
SMALL = 64
BLOCK = 2048
_SKETCH = pa.schema([("rk", pa.int64()), ("doc_id", pa.int64()), ("set_key", pa.int64()), ("mins", pa.binary()), ("bytes", pa.binary())])
_SKETCH_KIND = "rk bigint, doc_id bigint, set_key bigint, mins binary, bytes binary"
SEEDS = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def gram_set(text: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's word n-grams (lower case in ASCII); a shorter text is one gram."""
    h = hash_words(text, *words(text), LOWER)
    if not len(h):
        return np.zeros(0, np.uint32)
    return distinct((hash_grams(h, min(gram, len(h))) >> np.uint64(32)).astype(np.uint32))


def minwise(grams: np.ndarray, n: int) -> np.ndarray:
    """n minwise hashes (32 bits) of a set of grams."""
    if not len(grams):
        return np.zeros(n, np.uint32)
    a, b = SEEDS[:n] | np.uint64(1), SEEDS[512 : 512 + n]
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    g = grams.astype(np.uint64)
    with np.errstate(over="ignore"):
        g = mix(g + np.uint64(0x9E3779B97F4A7C15))
        for i in range(0, len(g), 4096):
            out = np.minimum(out, (g[i : i + 4096, None] * a + b).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def _sketch(gram: int, coordinates: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            keys, mins, low = [], [], []
            for i in range(len(batch)):
                g = gram_set(data[offsets[i] : offsets[i + 1]], gram)
                if not len(g):
                    keys.append(None), mins.append(None), low.append(None)
                    continue
                with np.errstate(over="ignore"):
                    keys.append(int(mix(np.array([mix(g.astype(np.uint64)).sum() + np.uint64(len(g))], np.uint64)).view(np.int64)[0]))
                own = minwise(g, coordinates)
                mins.append(own.tobytes()), low.append(own.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("rk"), batch.column("doc_id").cast(pa.int64()), pa.array(keys, pa.int64()), pa.array(mins, pa.binary()), pa.array(low, pa.binary())], schema=_SKETCH)

    return sketch


def sketches(docs: DataFrame, gram: int = GRAM, coordinates: int = COORDINATES) -> DataFrame:
    """(rk, doc_id, set_key, mins, bytes) of the documents that have any word; bytes has the last byte of each of mins."""
    return docs.select(row_key().alias("rk"), "doc_id", "text").mapInArrow(_sketch(gram, coordinates), _SKETCH_KIND).where(F.col("set_key").isNotNull())


def survival(depth: int) -> float:
    """Chance that a pair at the threshold still shares a bucket after so many splits of one run (a critical branching process)."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return q


def least_equal(threshold: float, coordinates: int, loss: float) -> int:
    """The greatest number of equal coordinates that a pair at the threshold falls short of with a chance of `loss` at most."""
    below = 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * threshold**k * (1 - threshold) ** (coordinates - k)
        if below > loss:
            return max(1, k)
    return coordinates


def depth_for(sets: int, small: int) -> int:
    """Splits until buckets of sets that share a sixteenth of what they hold are small."""
    return max(3, math.ceil(math.log(max(2, sets / small), 16)))


def runs_for(recall: float, depth: int) -> int:
    """Runs until a pair at the threshold is missed with a chance of 1 - recall at most. A hundredth of that chance is left to
    the comparison of sketches, see least_equal."""
    return max(1, math.ceil(math.log(0.99 * (1 - recall)) / math.log(1 - survival(depth))))


def _chosen(path: np.ndarray, coordinates: int, threshold: float) -> np.ndarray:
    """Which coordinates the node of each path samples: each with probability 1 / (threshold * coordinates)."""
    with np.errstate(over="ignore"):
        draw = mix(path[:, None] ^ (SEEDS[None, :coordinates] * np.uint64(0xA0761D6478BD642F)))
    return draw < np.uint64(min(2**64 - 1, int(2**64 / (threshold * coordinates))))


def _step(coordinates: int, threshold: float):
    """Splits each row's node: one row for every sampled coordinate, its path continued by the value there."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            path = batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            offsets, data = buffers(batch.column("mins"))
            mins = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint32).reshape(len(batch), coordinates)
            nodes, back = np.unique(path, return_inverse=True)
            row, at = np.nonzero(_chosen(nodes, coordinates, threshold)[back])
            with np.errstate(over="ignore"):
                new = mix(mix(path[row] + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB)) ^ mins[row, at].astype(np.uint64))
            picked = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), batch.column("set_key").take(picked), batch.column("parent").take(picked)], ["path", "set_key", "parent"])

    return step


def _roots(runs: int) -> list[int]:
    return [int(x) for x in mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)).view(np.int64)]


def buckets(sets: DataFrame, threshold: float, recall: float, small: int, depth: int, coordinates: int) -> DataFrame:
    """(path, n, set_key): the buckets of two sets or more in which the runs' paths end, each different group of sets once."""
    kind = "path bigint, set_key bigint, parent bigint"
    roots = F.array(*[F.lit(r) for r in _roots(runs_for(recall, depth))])
    open_rows = sets.select(F.explode(roots).alias("path"), "set_key", "mins", F.lit(np.iinfo(np.int64).max).alias("parent"))
    tables, rows, sizes = [], None, None
    for level in range(1, depth + 1):
        here = written(open_rows.mapInArrow(_step(coordinates, threshold), kind), "paths")
        # A bucket's count and two sums of hashes stand for the group of its sets.
        of = here.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent"), F.bit_xor(F.xxhash64("set_key")).alias("f"), F.bit_xor(F.xxhash64("set_key", F.lit(7))).alias("g"))
        of = written(of.where("n > 1"), "sizes")
        splits = (F.col("n") > small) & (F.col("n") <= F.col("parent") / 2)
        last = level == depth or of.where(splits).isEmpty()
        ready = of if last else of.where(~splits)
        rows = here if rows is None else rows.unionByName(here)
        sizes = ready if sizes is None else sizes.unionByName(ready)
        tables += [here, of]
        if last:
            break
        open_rows = here.drop("parent").join(of.where(splits).select("path", F.col("n").alias("parent")), "path").join(sets.select("set_key", "mins"), "set_key").select("path", "set_key", "mins", "parent")
    kept = sizes.groupBy("n", "f", "g").agg(F.min("path").alias("path")).select("path", "n")
    out = written(rows.select("path", "set_key").join(kept, "path"), "buckets")
    discard(*tables)
    return out


def blocks_of(bucketed: DataFrame, block: int) -> DataFrame:
    """bucketed (path, n, ...) with part and side: a bucket of more than block sets is cut into blocks, and each pair of blocks
    is a part of its own, where only sets of different sides are compared (within one block, side 0, all)."""
    count = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("set_key", "path"), count).cast("int")
    one = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    pairs = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own == j, 0).when(own < j, 1).otherwise(2).alias("side")))
    placed = bucketed.withColumn("p", F.explode(F.when(count == 1, F.array(one)).otherwise(pairs)))
    return placed.select("*", F.xxhash64("path", "p.i", "p.j").alias("part"), F.col("p.side").alias("side")).drop("p", "n")


def _comparable(side: np.ndarray, path: int, paths: list) -> np.ndarray:
    """Which pairs of a part are to be compared here: of two sides, and in no bucket with a smaller path before."""
    n = len(side)
    ok = side[:, None] != side[None, :] if side.any() else ~np.eye(n, dtype=bool)
    smaller = [[x for x in p if x < path] for p in paths]
    flat = np.array([x for p in smaller for x in p], np.int64)
    if len(flat):
        owner = np.repeat(np.arange(n), [len(p) for p in smaller])
        _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        several = count[at] > 1
        if several.any():
            _, at = np.unique(at[several], return_inverse=True)
            held = np.zeros((n, int(at.max()) + 1), np.float32)
            held[owner[several], at] = 1
            ok &= held @ held.T == 0
    return ok


def similar_within(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of one part have a Jaccard similarity of threshold or more, by brute force on the incidence matrix."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, gram, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    _, gram = np.unique(gram[shared], return_inverse=True)
    owner = owner[shared]
    by = np.argsort(gram, kind="stable")
    gram, owner = gram[by], owner[by]
    common = np.zeros((n, n), np.float32)
    width = 2048
    edge = np.searchsorted(gram, np.arange(0, (int(gram.max()) + 1 if len(gram) else 0) + width, width))
    for c, (lo, hi) in enumerate(zip(edge, edge[1:])):
        if lo < hi:
            held = np.zeros((n, int(gram[hi - 1]) - c * width + 1), np.float32)
            held[owner[lo:hi], gram[lo:hi] - c * width] = 1
            common += held @ held.T
    return common / (sizes[:, None] + sizes[None, :] - common) >= threshold - 1e-7


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list, list]]:
    """(path, keys, sides, paths, values) of each part in a partition that is sorted by part."""
    held, rows = None, []
    for batch in batches:
        for part, *row in zip(*[batch.column(c).to_pylist() for c in ("part", "path", "set_key", "side", "paths", "value")]):
            if part != held:
                if len(rows) > 1:
                    path, keys, sides, paths, values = zip(*rows)
                    yield path[0], np.array(keys, np.int64), np.array(sides), list(paths), list(values)
                held, rows = part, []
            rows.append(row)
    if len(rows) > 1:
        path, keys, sides, paths, values = zip(*rows)
        yield path[0], np.array(keys, np.int64), np.array(sides), list(paths), list(values)


_LIKELY = pa.schema([("part", pa.int64()), ("path", pa.int64()), ("set_key", pa.int64()), ("side", pa.int32()), ("paths", pa.list_(pa.int64()))])


def _likely(coordinates: int, least: int):
    """Of each part the sets that have a partner to be compared with here and so many equal minwise hashes."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def kept() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            path, keys, sides, paths, mins = zip(*rows)
            m = np.frombuffer(b"".join(mins), np.uint8).reshape(len(keys), coordinates)
            ok = _comparable(np.array(sides), path[0], list(paths))
            if not ok.any():
                return
            keep = np.zeros(len(keys), bool)
            for i in range(0, len(keys), 64):
                equal = np.zeros((len(m[i : i + 64]), len(m)), np.int16)
                for c in range(coordinates):
                    equal += m[i : i + 64, c, None] == m[None, :, c]
                keep[i : i + 64] = ((equal >= least) & ok[i : i + 64]).any(1)
            at = np.flatnonzero(keep).tolist()
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([held] * len(at), [path[0]] * len(at), [keys[i] for i in at], [sides[i] for i in at], [paths[i] for i in at]), _LIKELY)], schema=_LIKELY)

        for batch in batches:
            for part, *row in zip(*[batch.column(c).to_pylist() for c in ("part", "path", "set_key", "side", "paths", "mins")]):
                if part != held:
                    yield from kept()
                    held, rows = part, []
                rows.append(row)
        yield from kept()

    return likely


def components_within(ok: np.ndarray) -> np.ndarray:
    """The first place of the component of each place in a symmetric matrix of links."""
    at = np.arange(len(ok))
    while True:
        new = np.minimum(at, np.where(ok, at[None, :], len(ok)).min(1))
        new = new[new]
        if (new == at).all():
            return at
        at = new


_LINKS = pa.schema([("set_key", pa.int64()), ("least", pa.int64()), ("links", pa.int64())])
_LINKS_KIND = "set_key bigint, least bigint, links bigint"


def _brute(threshold: float):
    """(set_key, least, links): with how many sets of a part each is similar, and the least key of its component there."""

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, keys, sides, paths, values in _parts(batches):
            ok = _comparable(sides, path, paths)
            if not ok.any():
                continue
            ok &= similar_within([np.frombuffer(v, np.uint32) for v in values], threshold)
            linked = np.flatnonzero(ok.any(1))
            if len(linked):
                linked = linked[np.argsort(keys[linked])]
                ok, own = ok[np.ix_(linked, linked)], keys[linked]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own[components_within(ok)]), pa.array(ok.sum(1), pa.int64())], schema=_LINKS)

    return brute


def _gram_sets(gram: int):
    def gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            grams = [gram_set(data[offsets[i] : offsets[i + 1]], gram).tobytes() for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("set_key"), pa.array(grams, pa.binary())], ["set_key", "grams"])

    return gram_sets


def similar_sets(docs: DataFrame, sets: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, depth: int | None = None, coordinates: int = COORDINATES, block: int = BLOCK) -> DataFrame:
    """(set_key, least, links), several rows a key: distinct sets (set_key, rk, mins, bytes) with how many others they are similar to and
    the least key of those that they are joined with, so that rows joined by least form the components of all similar pairs.

    A pair is compared in the bucket of least path that both are in, and nowhere else, so links only have to be summed and what
    moves follows the sets, not their pairs. Sets leave a bucket where no partner's sketch is near enough; only the texts of
    the others are read for their grams, one of each set.
    """
    found = buckets(sets.select("set_key", "mins"), threshold, recall, small, depth or depth_for(sets.count(), small), coordinates)
    of = found.groupBy("set_key").agg(F.collect_list("path").alias("paths"))
    held = found.join(of.join(sets.select("set_key", F.col("bytes").alias("mins")), "set_key"), "set_key")
    placed = blocks_of(held, block).repartition("part").sortWithinPartitions("part")
    likely = written(placed.mapInArrow(_likely(coordinates, least_equal(threshold, coordinates, 0.01 * (1 - recall))), "part bigint, path bigint, set_key bigint, side int, paths array<bigint>"), "likely")
    wanted = sets.select("set_key", "rk").join(likely.select("set_key").distinct(), "set_key", "left_semi")
    grams = docs.select(row_key().alias("rk"), "text").join(wanted, "rk").select("set_key", "text").mapInArrow(_gram_sets(gram), "set_key bigint, grams binary").dropDuplicates(["set_key"])
    rows = likely.join(grams.withColumnRenamed("grams", "value"), "set_key").repartition("part").sortWithinPartitions("part")
    out = written(rows.mapInArrow(_brute(threshold), _LINKS_KIND), "links")
    discard(found, likely)
    return out


def _prepared(docs: DataFrame, gram: int, coordinates: int) -> tuple[DataFrame, DataFrame]:
    """(rk, doc_id, set_key) of every document, and one (set_key, rk, mins, bytes) for each distinct set."""
    members = written(sketches(docs, gram, coordinates), "members")
    sets = written(members.groupBy("set_key").agg(F.min("rk").alias("rk"), F.first("mins").alias("mins"), F.first("bytes").alias("bytes")), "sets")
    return members.select("rk", "doc_id", "set_key"), sets


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL, small: int = SMALL, depth: int | None = None, coordinates: int = COORDINATES, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, copies, links): each document that is similar to another, whose sets of word n-grams have that Jaccard
    similarity. class_id is the least id of its class, the component of similar documents; copies is the number of other
    documents with an equal set, links that of different sets that are similar to its own. Others have no row: they are
    alone in their class.

    Sets are of 32-bit hashes of grams, of which similarities are exact; a pair at the threshold is found with a chance of at
    least `recall`, more similar ones with more, and documents with equal sets always. Texts that are null or without
    words are similar to none; documents with a null id are left out, as no row can name them, but link others; rows that
    repeat with one id count once. Long texts are compared whole. An empty table gives an empty one.
    """
    members, sets = _prepared(docs, gram, coordinates)
    similar = similar_sets(docs, sets, gram, threshold, recall, small, depth, coordinates, block)
    links = similar.groupBy("set_key").agg(F.sum("links").alias("links"))
    roots = components(similar.select(F.col("set_key").alias("a"), F.col("least").alias("b")))
    named = members.where("doc_id is not null").groupBy("set_key", "doc_id").agg(F.lit(1).alias("one"))
    sizes = members.groupBy("set_key").agg(F.count_distinct("doc_id").alias("n"))
    classes = sizes.join(links, "set_key", "left").where("n > 1 or links is not null").join(roots, sizes["set_key"] == roots["node"], "left")
    classes = classes.select("set_key", F.coalesce("root", "set_key").alias("root"), (F.col("n") - 1).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    rows = written(named.join(classes, "set_key").select("doc_id", "root", "copies", "links"), "rows")
    firsts = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    # An id of several texts is of the class of its least one.
    joined = rows.join(firsts, "root").select("doc_id", "class_id", "copies", "links")
    return joined.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("copies").alias("copies"), F.sum("links").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of edges (a, b), by large-star and small-star steps.

    Each round writes its edges to the shared folder; rounds go on until none changes them.
    """
    now = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        up = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(up, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        after = written(small, "edges")
        sums = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        same = now.agg(*sums).first() == after.agg(*sums).first()
        discard_now, now = now, after

        discard(discard_now)
        if same:
            return now.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL, small: int = SMALL, depth: int | None = None, coordinates: int = COORDINATES, block: int = BLOCK) -> DataFrame:
    """docs with one document of each group of near copies, its own columns only, whatever their names.

    Groups are the components of similar pairs; the one with the least id (nulls last, then the key of the row) stays. Of
    rows that repeat id and text one stays. Documents with null or empty texts or without words are no copies of one another
    and all stay. An empty table stays empty.
    """
    members, sets = _prepared(docs, gram, coordinates)
    similar = similar_sets(docs, sets, gram, threshold, recall, small, depth, coordinates, block)
    roots = components(similar.select(F.col("set_key").alias("a"), F.col("least").alias("b")))
    grouped = members.join(roots, members["set_key"] == roots["node"], "left").withColumn("root", F.coalesce("root", "set_key"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rk"))
    key, kept_id, number = fresh(docs, "rk", "kept_id", "number")
    kept = grouped.groupBy("root").agg(F.min_by(F.struct("rk", "doc_id"), order).alias("k")).select(F.col("k.rk").alias(key), F.col("k.doc_id").alias(kept_id))
    keyed = docs.withColumn(key, row_key())
    wordless = F.col("text").isNull() | ~F.col("text").rlike(r"[^\t\n\x0B\f\r ]")
    stay = keyed.where(~wordless).join(kept, (keyed[key] == kept[key]) & keyed["doc_id"].eqNullSafe(kept[kept_id]), "left_semi")
    stay = stay.withColumn(number, F.row_number().over(Window.partitionBy(key, "doc_id").orderBy(key))).where(F.col(number) == 1)
    return stay.select(*docs.columns).unionByName(keyed.where(wordless).select(*docs.columns))
