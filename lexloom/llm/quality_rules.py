"""Quality rules by compression: zstandard ratios of the whole document and of fixed chunks against bands by length."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import buffers, fresh

LEVEL = 3
CHUNK = 4096
#: (up to so many bytes, least ratio, greatest ratio) of the whole document; a ratio is bytes before by bytes after.
BANDS = ((64, 0.0, 2.0), (256, 0.0, 2.5), (1024, 1.1, 2.6), (4096, 1.25, 3.0), (1 << 62, 1.25, 3.4))
#: The same for one chunk; a tail shorter than a quarter of a chunk belongs to the chunk before.
CHUNK_BAND = (1.2, 3.2)
KIND = "struct<bytes:bigint,ratio:double,least_chunk:double,most_chunk:double,chunks:int>"


def _measure(level: int, chunk: int):
    def measure(text: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        offsets, data = buffers(text)
        out = []
        for i in range(len(text)):
            doc = data[offsets[i] : offsets[i + 1]]
            n = len(doc)
            if not n:
                out.append({"bytes": 0, "chunks": 0})
                continue
            whole = n / len(press.compress(doc))
            cuts = [*range(0, max(1, n - chunk // 4), chunk), n]
            each = [(b - a) / len(press.compress(doc[a:b])) for a, b in zip(cuts, cuts[1:])] if len(cuts) > 2 else [whole]
            out.append({"bytes": n, "ratio": round(whole, 6), "least_chunk": round(min(each), 6), "most_chunk": round(max(each), 6), "chunks": len(each)})
        return pa.array(out, pa.struct([("bytes", pa.int64()), ("ratio", pa.float64()), ("least_chunk", pa.float64()), ("most_chunk", pa.float64()), ("chunks", pa.int32())]))

    return measure


def compression_verdicts(docs: DataFrame, text: str = "text", out: str = "quality", level: int = LEVEL, chunk: int = CHUNK, bands=BANDS, chunk_band=CHUNK_BAND) -> DataFrame:
    """docs with the struct column `out`: bytes, ratio, least_chunk, most_chunk, chunks, reason (null where the document passes).

    Reasons: empty (null or empty text), repetitive (the document or one chunk shrinks more than its band
    allows), incompressible (less). Chunks count only where there are two or more. Every other column stays as it is,
    except one named like `out`, which is replaced. Rows that repeat are judged alike and all kept or all dropped.
    A very long text is compressed whole. An empty table gives an empty table.
    """
    measured = docs.withColumn(out, F.arrow_udf(_measure(level, chunk), KIND)(F.col(text)))
    m = F.col(out)
    low = high = None
    for most, a, b in reversed(bands):
        low = F.lit(a) if low is None else F.when(m["bytes"] <= most, a).otherwise(low)
        high = F.lit(b) if high is None else F.when(m["bytes"] <= most, b).otherwise(high)
    several = m["chunks"] > 1
    reason = (
        F.when(m["bytes"] == 0, "empty")
        .when((m["ratio"] > high) | (several & (m["most_chunk"] > chunk_band[1])), "repetitive")
        .when((m["ratio"] < low) | (several & (m["least_chunk"] < chunk_band[0])), "incompressible")
    )
    return measured.withColumn(out, m.withField("reason", reason))


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns, whatever their names.

    Null and empty texts are rejected; rows that repeat all stay or all go; very long texts are compressed whole; an empty
    table stays empty.
    """
    (name,) = fresh(docs, "quality")
    judged = compression_verdicts(docs, out=name, **options)
    return judged.where(F.col(name)["reason"].isNull()).drop(name)
