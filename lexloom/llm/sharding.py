"""Sharding along a Hilbert curve: quantise metadata, sort by curve index, cut runs of about equal bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import fresh, running_sum

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 4
SHARD_BYTES = 8 << 20
#: Shard starts that are sent to every worker at most; beyond it documents are joined with their shard numbers.
MOST_STARTS = 1 << 16
#: Partitions that the result has at most, beyond those that the session sets for shuffles: one for so many bytes of text.
PARTITION_BYTES = 1 << 28


def hilbert_index(coordinates: Sequence[int], bits: int) -> int:
    """The place on the Hilbert curve of a cell, by Skilling's transposition."""
    x, n = list(coordinates), len(coordinates)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def curve_table(dimensions: int, bits: int) -> list[int]:
    """Curve indexes of all cells, in row-major order; its size is fixed by the parameters."""
    if dimensions * bits > 16:
        raise ValueError("dimensions * bits must be 16 at most")
    side = 1 << bits
    return [hilbert_index([code >> bits * (dimensions - 1 - d) & (side - 1) for d in range(dimensions)], bits) for code in range(side**dimensions)]


def quantile_cuts(docs: DataFrame, dimensions: Sequence[str], bits: int) -> list[list]:
    """For each dimension the values at which its bucket grows, from exact counts over all rows.

    The bucket of a value is floor(2**bits * rows with a smaller value / rows); null is the smallest value.
    There are fewer than 2**bits values a dimension.
    """
    kinds = dict(docs.dtypes)
    counts = None
    for d, name in enumerate(dimensions):
        text = kinds[name] == "string"
        one = docs.groupBy(F.lit(d).alias("d"), (F.lit(None).cast("double") if text else F.col(name).cast("double")).alias("number"), (F.col(name) if text else F.lit(None).cast("string")).alias("word")).agg(F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    placed = running_sum(counts, ["d", "number", "word"], "n", "before")
    total = docs.count()
    bucket = F.floor((F.col("before") - F.col("d") * F.lit(total)) * F.lit(1 << bits) / F.lit(total)) if total else F.lit(0)
    firsts = placed.withColumn("bucket", bucket.cast("int")).groupBy("d", "bucket").agg(F.min(F.struct("before", "number", "word")).alias("first"))
    cuts: list[list] = [[] for _ in dimensions]
    for r in sorted(firsts.collect(), key=lambda r: (r["d"], r["bucket"])):
        value = r["first"]["word"] if kinds[dimensions[r["d"]]] == "string" else r["first"]["number"]
        cuts[r["d"]].append((r["bucket"], value))
    return cuts


def _bucket(column: Column, cuts: list) -> Column:
    out = F.lit(0)
    for bucket, value in cuts:
        if value is not None and bucket:
            out = F.when(column >= F.lit(value), bucket).otherwise(out)
    return out


def curve_column(docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> Column:
    cuts = quantile_cuts(docs, dimensions, bits)
    kinds = dict(docs.dtypes)
    code = F.lit(0)
    for name, own_cuts in zip(dimensions, cuts):
        code = code * (1 << bits) + _bucket(F.col(name) if kinds[name] == "string" else F.col(name).cast("double"), own_cuts)
    table = F.lit(np.array(curve_table(len(dimensions), bits), np.int32))
    return F.get(table, code).cast("bigint")


def starts_at(shard: np.ndarray, curve: np.ndarray, first: np.ndarray, c: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The shard of each (c, i): the last that begins, at (curve, first), no later."""
    low, high = np.zeros(len(c), np.int64), np.full(len(c), len(shard), np.int64)
    while (low < high).any():
        middle = np.minimum((low + high) // 2, len(shard) - 1)
        before = (curve[middle] < c) | ((curve[middle] == c) & (first[middle] <= i))
        open_ = low < high
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
    return shard[np.maximum(low - 1, 0)]


def hilbert_shards(docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, shard_bytes: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text", most_starts: int = MOST_STARTS) -> DataFrame:
    """docs with curve (the Hilbert index of the quantised dimensions) and shard, rows of a shard together and in order.

    Rows are ordered by curve and id (nulls first); a shard is a run of that order, and a row belongs to shard
    floor(bytes of text before its id on the curve / shard_bytes), so a shard exceeds shard_bytes by less than one id's rows.
    Each partition, and so each file, holds a run of neighbouring shards, so that the files' least and greatest values of
    each dimension leave most of them out of a read. Rows that repeat share a shard. A null text has no bytes; a null in a
    dimension counts as its smallest value; a dimension that docs lacks is an error. Columns named curve or shard are
    replaced, others stay, whatever their names. An empty table stays empty.
    """
    base = docs.drop("curve", "shard")
    for name in dimensions:
        if name not in base.columns:
            raise ValueError(f"no column {name}")
    (size,) = fresh(base, "size")
    narrow = base.select(*dict.fromkeys([doc_id, *dimensions]), F.coalesce(F.octet_length(text), F.lit(0)).alias(size))
    curve = curve_column(narrow, dimensions, bits)
    sizes = narrow.withColumn("curve", curve).groupBy("curve", F.col(doc_id).alias("id")).agg(F.sum(size).cast("bigint").alias("n"))
    shards = running_sum(sizes, ["curve", "id"], "n", "before").withColumn("shard", F.floor(F.col("before") / shard_bytes).cast("bigint"))
    end = shards.agg(F.max("shard").alias("m"), F.sum("n").alias("bytes")).first()
    most, total = end["m"] or 0, end["bytes"] or 0
    placed = base.withColumn("curve", curve)
    if most < most_starts and dict(docs.dtypes)[doc_id] in ("bigint", "int", "smallint", "tinyint"):
        starts = shards.groupBy("shard").agg(F.min(F.struct(F.col("curve"), F.col("id").isNotNull().alias("given"), F.col("id"))).alias("start"))
        rows = sorted(starts.collect(), key=lambda r: r["shard"])
        low = np.iinfo(np.int64).min
        sent = docs.sparkSession.sparkContext.broadcast((
            np.array([r["shard"] for r in rows], np.int64), np.array([r["start"]["curve"] for r in rows], np.int64), np.array([low if r["start"]["id"] is None else r["start"]["id"] for r in rows], np.int64),
        ))

        def find(curve: pa.Array, ids: pa.Array) -> pa.Array:
            c, i = curve.to_numpy(zero_copy_only=False).astype(np.int64), ids.cast(pa.int64()).fill_null(low).to_numpy(zero_copy_only=False)
            return pa.array(starts_at(*sent.value, c, i) if len(sent.value[0]) else np.zeros(len(c), np.int64))

        placed = placed.withColumn("shard", F.arrow_udf(find, "bigint")(F.col("curve"), F.col(doc_id)))
    else:
        other, same, number = fresh(placed, "other_curve", "other_id", "other_shard")
        n = shards.select(F.col("curve").alias(other), F.col("id").alias(same), F.col("shard").alias(number))
        placed = placed.join(n, placed["curve"].eqNullSafe(n[other]) & placed[doc_id].eqNullSafe(n[same])).withColumn("shard", F.col(number)).drop(other, same, number)
    parts = min(most + 1, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES)))
    run = F.floor(F.col("shard") * F.lit(parts) / F.lit(most + 1)).cast("int")
    return placed.repartitionById(parts, run).sortWithinPartitions("shard", "curve", F.col(doc_id).asc_nulls_first())
