"""Words counted inside Python tasks, so that what is shuffled is counts or rows that were asked for, not every word of every text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a task holds before it hands them on.
HELD = 300_000
#: Bits of the filter by which texts are searched for asked grams; what passes it is joined.
BITS = 24
_QUOTES, _PLAIN = re.compile("['`\"]"), re.compile("[^a-z0-9]+")


def plain_words(text: str | None) -> list[str]:
    """What corpus.words() gives."""
    return [t for t in _PLAIN.split(_QUOTES.sub("", (text or "").lower())) if t]


def unique(docs: DataFrame, column: str = "id") -> bool:
    """Whether no id stands twice; reads ids only."""
    return docs.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def frequencies(docs: DataFrame, split: Callable[[str | None], list[str]], fields: tuple[str, ...] = ("title", "body")) -> DataFrame:
    """(field, term, df, tf) of the fields, among title, body and either, for docs (title, body) of which each is one row."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {f: (Counter(), Counter()) for f in fields}

        def rows() -> pd.DataFrame:
            parts = [pd.DataFrame({"field": f, "term": list(df), "df": list(df.values()), "tf": [tf[t] for t in df]}) for f, (df, tf) in held.items()]
            for df, tf in held.values():
                df.clear()
                tf.clear()
            return pd.concat([p for p in parts if len(p)] or [pd.DataFrame({"field": [""], "term": [""], "df": [0], "tf": [0]})], ignore_index=True)

        for frame in frames:
            for title, body in zip(frame["title"], frame["body"]):
                t, b = split(title), split(body)
                words = {"title": t, "body": b, "either": t + b}
                for f, (df, tf) in held.items():
                    df.update(set(words[f]))
                    tf.update(words[f])
                if max(len(df) for df, _ in held.values()) > HELD:
                    yield rows()
        yield rows()

    parts = docs.select("title", "body").mapInPandas(counted, "field string, term string, df bigint, tf bigint")
    return parts.where("df > 0").groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


class Grams:
    """Hashes of word n-grams: of all n-grams of many texts at once, or of given ones."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 1_000_000:
            self.known.clear()
        get, out = self.known.get, []
        for w in words:
            h = get(w)
            if h is None:
                h = self.known[w] = (zlib.crc32(w.encode()) | zlib.adler32(w.encode()) << 32) * 0x9E3779B97F4A7C15 % 2**64
            out.append(h)
        return np.array(out, dtype=np.uint64)

    @staticmethod
    def combined(h: np.ndarray, n: int) -> np.ndarray:
        """The place in the filter of each n-gram of the words hashed in h."""
        total = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
        for j in range(n):
            total = total * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(total)]
        return (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)


def _filter_of(wanted: DataFrame) -> np.ndarray:
    """The filter's bits for wanted (gram); BITS decide its size, whatever the number of grams."""

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for frame in frames:
            split = [g.split(" ") for g in frame["gram"]]
            yield pd.DataFrame({"p": np.array([grams.combined(grams.hashes(ws), len(ws))[0] for ws in split], dtype=np.int64)})

    bits = wanted.mapInPandas(places, "p bigint").groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(2**BITS, dtype=bool)
    for r in bits.collect():
        # Bit positions of a bucket are those of p - 1 for p > 0 and of -p else.
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little"))
        p = at + (r["bucket"] - 1) * 32768 + 1
        out[p[(p >= 0) & (p < len(out))]] = True
        if r["bucket"] == 0 and 0 in at:
            out[0] = True
    return out


def present(docs: DataFrame, wanted: DataFrame, least: int, most: int, edges: tuple[str, ...] = ()) -> DataFrame:
    """(id, gram, in_title): which wanted grams (gram) of least to most words stand in the titles and bodies of docs, among those that
    neither begin nor end with one of `edges`."""
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(_filter_of(wanted)).tobytes())

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, seen, closed = Grams(), np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool), set(edges)
        for frame in frames:
            ids, split = frame["id"].to_numpy(), [plain_words(x) for f in ("title", "body") for x in frame[f]]
            words = [w for ws in split for w in ws]
            text = np.repeat(np.arange(len(split)), [len(ws) for ws in split])
            h, inner = grams.hashes(words), np.array([w not in closed for w in words], dtype=bool)
            hits = set()
            for n in range(least, most + 1):
                m = len(words) - n + 1
                if m <= 0:
                    continue
                ok = seen[grams.combined(h, n).astype(np.int64)] & inner[:m] & inner[n - 1 :] & (text[:m] == text[n - 1 :])
                hits.update((int(text[i]), " ".join(words[i : i + n])) for i in np.flatnonzero(ok))
            if hits:
                yield pd.DataFrame({"id": [ids[t % len(ids)] for t, _ in hits], "gram": [g for _, g in hits], "in_title": [t < len(ids) for t, _ in hits]})

    kind = dict(docs.dtypes)["id"]
    rows = docs.select("id", "title", "body").mapInPandas(found, f"id {kind}, gram string, in_title boolean")
    return rows.join(wanted, "gram", "left_semi").groupBy("id", "gram").agg(F.max("in_title").alias("in_title"))
