"""Mixing sources to target weights by pivotal dependent rounding of fractional copy counts."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import fresh, running_sum, written

#: Share of a source by default: its characters to this power.
ALPHA = 0.7
SEED = 20240607
#: Units that one task rounds, and residuals that one node of the tree combines.
BLOCK_UNITS = 1 << 16
FAN_IN = 64
_UNIT = "source string, block bigint, rk bigint, repeats bigint, whole bigint, part double, taken int"
_ARROW = pa.schema([("source", pa.string()), ("block", pa.int64()), ("rk", pa.int64()), ("repeats", pa.int64()), ("whole", pa.int64()), ("part", pa.float64()), ("taken", pa.int32())])
_EPS = 1e-9


def pivotal_round(parts: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """Rounds probabilities pair by pair: mass moves at random until one of the two is 0 or 1.

    Returns 0 or 1 for each unit, -1 for the one that stays fractional, its place (-1 if none) and its probability.
    Expectations are kept, and the sum changes by nothing but what the last unit holds.
    """
    out = np.full(len(parts), -1, np.int32)
    draws = rng.random(len(parts)).tolist()
    held, p = -1, 0.0
    for i, q in enumerate(parts.tolist()):
        if q <= _EPS or q >= 1 - _EPS:
            out[i] = int(q > 0.5)
            continue
        if held < 0:
            held, p = i, q
            continue
        s = p + q
        if s < 1 - _EPS:
            if draws[i] * s < p:
                out[i], p = 0, s
            else:
                out[held], held, p = 0, i, s
        elif s <= 1 + _EPS:
            first = draws[i] < p
            out[held], out[i] = int(first), int(not first)
            held, p = -1, 0.0
        else:
            if draws[i] * (2 - s) < 1 - q:
                out[held], held, p = 1, i, s - 1
                # held's unit is complete; i keeps the rest
            else:
                out[i], p = 1, s - 1
    return out, held, p


def _node(seed: int, level: int, last: bool):
    def node(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("rk", "ascending")])
        block, name = key[1].as_py(), key[0].as_py()
        rng = np.random.default_rng([seed, level, block & 0x7FFFFFFFFFFFFFFF, *(name.encode() if name is not None else (256,))])
        order = rng.permutation(len(table))
        table = table.take(order)
        out, held, p = pivotal_round(table["part"].to_numpy(), rng)
        part = np.zeros(len(out))
        if held >= 0:
            if last:
                out[held] = int(rng.random() < p)
            else:
                part[held] = p
        return table.set_column(5, "part", pa.array(part)).set_column(6, "taken", pa.array(out, pa.int32())).cast(_ARROW)

    return node


def round_units(units: DataFrame, blocks: int, seed: int = SEED, fan_in: int = FAN_IN) -> DataFrame:
    """units with taken set to 0 or 1: blocks are rounded apart, their residuals combined level by level up a tree."""
    decided, level = None, 0
    while True:
        last = blocks <= 1
        done = written(units.groupBy("source", "block").applyInArrow(_node(seed, level, last), _UNIT), "rounded")
        fixed = done.where("taken >= 0")
        decided = fixed if decided is None else decided.unionByName(fixed)
        if last:
            return decided
        blocks, level = -(-blocks // fan_in), level + 1
        units = done.where("taken < 0").withColumn("block", F.floor(F.col("block") / fan_in).cast("bigint"))


def unit_key():
    """A 64-bit key of a row by its source, id and text: a unit of rounding is all the rows that repeat these three."""
    return F.xxhash64("source", F.col("source").isNull(), "doc_id", "text")


def copy_counts(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, budget: float = 1.0, seed: int = SEED, block_units: int = BLOCK_UNITS) -> DataFrame:
    """(source, rk, repeats, total): for each unit, how many rows it has and how many copies they have together."""
    if weights is not None and any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    keyed = docs.select(F.col("source"), unit_key().alias("rk"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    rows = written(keyed.groupBy("rk", "source").agg(F.count(F.lit(1)).alias("m"), F.max("n").cast("bigint").alias("n")), "units")
    by = rows.groupBy("source").agg(F.sum(F.col("n") * F.col("m")).alias("size"), F.count(F.lit(1)).alias("units"))
    if weights is None:
        wanted = by.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        wanted = by.join(given, by["source"].eqNullSafe(given["source"]), "left").drop(given["source"]).withColumn("w", F.coalesce("w", F.lit(0.0)))
    sums = wanted.agg(F.sum("w").alias("w_all"), F.sum("size").alias("size_all"), F.max("units").alias("most"))
    most = sums.first()["most"] or 0
    blocks = max(1, -(-most // block_units))
    rate = F.when((F.col("size") > 0) & (F.col("w_all") > 0), F.col("w") / F.col("w_all") * F.col("size_all") * F.lit(budget) / F.col("size")).otherwise(F.lit(0.0))
    rates = wanted.crossJoin(sums).select(F.col("source").alias("other"), F.round(rate, 9).alias("rate"))
    share = F.round(F.col("rate") * F.col("m"), 9)
    units = rows.join(rates, rows["source"].eqNullSafe(rates["other"])).select("source", F.pmod(F.xxhash64("rk"), F.lit(blocks)).alias("block"), "rk", F.col("m").alias("repeats"), F.floor(share).alias("whole"), (share - F.floor(share)).alias("part"), F.lit(-1).alias("taken"))
    decided = round_units(units, blocks, seed)
    return decided.select("source", "rk", "repeats", (F.col("whole") + F.col("taken")).alias("total"))


def with_copies(docs: DataFrame, out: str = "copies", **options) -> DataFrame:
    """docs with `out`, how many copies of each row the mixture holds; 0 means that it is left out.

    The share of a source in characters is its weight by all weights (by default characters ** alpha); the mixture has
    budget * the characters of docs. The copies of a row are the whole part of its source's rate or one more, and those of a
    source add up to its rate times its rows, to within one. The same seed gives the same result. A null source is a source
    of its own; rows with null or empty texts have the rate of their source, 0 if it has no characters; sources that weights
    lacks get none; weights that are negative or not finite are refused. Rows that repeat source, id and text are one unit,
    whose copies are dealt out evenly, to within one; rows of two sources never share a unit. A column named `out` is
    replaced; all others stay, whatever their names. An empty table stays empty.
    """
    base = docs.drop(out)
    counts = written(copy_counts(base, **options), "copies")
    key, source, rk, repeats, total, place = fresh(base, "key", "unit_source", "unit", "repeats", "total", "place")
    counted = counts.select(F.col("source").alias(source), F.col("rk").alias(rk), F.col("repeats").alias(repeats), F.col("total").alias(total))
    joined = base.withColumn(key, unit_key()).join(counted, (F.col(key) == F.col(rk)) & F.col("source").eqNullSafe(F.col(source)))
    single = joined.where(F.col(repeats) == 1).withColumn(out, F.col(total).cast("int"))
    if counts.where("repeats > 1").isEmpty():
        return single.select(*base.columns, out)
    # Where each row of a unit stands among its like, by the place of its file and of itself there, however many there are.
    several = written(joined.where(F.col(repeats) > 1), "repeats")
    path, row, one = fresh(several, "file", "row", "one")
    placed = running_sum(several.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row), F.lit(1).alias(one)), [rk, path, row], one, place)
    (least,) = fresh(placed, "least")
    (again,) = fresh(placed.withColumn(least, F.lit(0)), "again")
    firsts = placed.groupBy(rk).agg(F.min(place).alias(least)).withColumnRenamed(rk, again)
    number = F.col(place) - F.col(least)
    dealt = F.floor(F.col(total) / F.col(repeats)) + (number < F.col(total) % F.col(repeats)).cast("int")
    even = placed.join(firsts, F.col(rk) == F.col(again)).withColumn(out, dealt.cast("int"))
    return single.select(*base.columns, out).unionByName(even.select(*base.columns, out))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row as often as with_copies says, with its own columns, whatever their names; what is said
    there of nulls, repeats and empty tables holds here."""
    (copies,) = fresh(docs, "copies")
    counted = with_copies(docs, out=copies, **options)
    (copy,) = fresh(counted, "copy")
    return counted.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
