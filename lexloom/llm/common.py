"""What several operators share: durable cuts of lineage, whole-table reading, hashing of words."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Spark's setting that the shuffle files of a query are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, with one folder in it for the application.

    Where it is unset a temporary folder is made, but only if driver and executors are one process, as in tests; on a
    cluster each machine would have its own, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/lexloom-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: a cut of lineage that outlives any executor.

    Whoever has read it for the last time calls discard(); release() deletes what results that are still lazy need. The
    shuffle files behind the table are of no use once it is written, and are deleted then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() made and that nothing reads any more."""
    for df in tables:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            _delete(df.sparkSession, f)


def release(spark: SparkSession) -> None:
    """Deletes every table that written() made in this application; only for when no result is read any more."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of the given ones that df doesn't have, so that a user's columns are never met."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`, the sum of `value` over all rows before this one in `order`, which must tell rows apart.

    Rows are range-partitioned once and kept in the shared folder; only one total of each partition is gathered.
    """
    part, total, before = fresh(df, "part", "total", "before_part")
    parts = written(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn(part, F.spark_partition_id()), "ranges")
    totals = parts.groupBy(part).agg(F.sum(value).alias(total))
    sums = totals.select(part, F.coalesce(F.sum(total).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    own_rows = Window.partitionBy(part).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumn(out, F.coalesce(F.sum(value).over(own_rows), F.lit(0)))
    return inside.join(F.broadcast(sums), part).withColumn(out, F.col(out) + F.col(before)).drop(part, before)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of a row by its id and text; rows that repeat both count as one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without copying; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on all of x."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


_LOW, _HIGH = (_powers(_BASE, _STEP), _powers(pow(_BASE, _STEP, 1 << 64), _STEP))
_INV_LOW, _INV_HIGH = (_powers(_BASE_INVERSE, _STEP), _powers(pow(_BASE_INVERSE, _STEP, 1 << 64), _STEP))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't ASCII white space."""
    blank = np.ones(len(data) + 2, bool)
    np.take(_SPACE, data, out=blank[1:-1])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial modulo 2**64; fold maps bytes first."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(data)
    with np.errstate(over="ignore"):
        value = (_BYTE if fold is None else _BYTE[fold])[data]
        for at in range(0, n, _STEP):
            value[at : at + _STEP] *= _LOW[: n - at]
            if at:
                value[at : at + _STEP] *= _HIGH[at // _STEP]
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(value, out=sums[1:])
        inverse = _INV_LOW[start] if n <= _STEP else _INV_LOW[start % _STEP] * _INV_HIGH[start // _STEP]
        return mix((sums[end] - sums[start]) * inverse + (end - start).astype(np.uint64))


def hash_grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, given the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(_BASE) + h[j : j + n]
    return mix(out)


#: ASCII letters to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_words(text: bytes, fold: np.ndarray | None = None) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return hash_words(data, *words(data), fold)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; x is sorted in place."""
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x
