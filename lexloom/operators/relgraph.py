"""Relationship compiler: references resolved, domain relationships expanded, graphs filtered and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.durable import written
from lexloom.errors import InvalidArtifactError
from lexloom.functions.text import clamp01

#: type: (symmetric, used by search)
TYPES = {"semantic": (False, True), "editorial": (True, True), "manually-related": (True, True), "same-category": (True, False), "prerequisite": (False, False), "supersedes": (False, False)}
SYMMETRIC = tuple(t for t, (s, _) in TYPES.items() if s)
RUNTIME = tuple(t for t, (_, r) in TYPES.items() if r)


def type_table(spark) -> DataFrame:
    return spark.createDataFrame([(t, s, r) for t, (s, r) in TYPES.items()], "type string, symmetric boolean, search boolean")


def normal_path(path: Column) -> Column:
    """A path without host, query, fragment, index page and outer slashes."""
    p = F.regexp_replace(F.lower(F.trim(path)), r"^https?://[^/]+|[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(p, r"(index)?\.(html?|md)$", ""), "^/+|/+$", "")


def references(docs: DataFrame) -> DataFrame:
    """(ref, id, priority): what names a document: its id, its path, the last part of that."""
    path = normal_path(F.coalesce(F.try_element_at("metadata", F.lit("path")), F.col("id")))
    rows = F.array(F.struct(F.col("id").alias("ref"), F.lit(0).alias("priority")), F.struct(path.alias("ref"), F.lit(1).alias("priority")), F.struct(F.substring_index(path, "/", -1).alias("ref"), F.lit(2).alias("priority")))
    return docs.select("id", F.explode(rows).alias("r")).select("r.ref", "id", "r.priority").where("ref <> ''")


def resolved(rows: DataFrame, column: str, refs: DataFrame, out: str) -> DataFrame:
    """rows with the document that a reference names: by id, else path, else slug; the least id of several; null without one."""
    keyed = written(rows.withColumn("_row", F.monotonically_increasing_id()), "references")
    names = keyed.select("_row", F.explode(F.array(F.struct(F.col(column).alias("ref"), F.lit(0).alias("by")), F.struct(normal_path(F.col(column)).alias("ref"), F.lit(1).alias("by")))).alias("n")).select("_row", "n.ref")
    best = names.join(refs, "ref").groupBy("_row").agg(F.min(F.struct("priority", "id")).alias("b")).select("_row", F.col("b.id").alias(out))
    return keyed.join(best, "_row", "left").drop("_row")


def compiled_domain(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges of domain relationships (source, target, type, priority, provenance[, directional]); symmetric types go both ways
    unless the row says that it is directional.

    Raises InvalidArtifactError where a reference is missing, names no document or names its own source, or a type is unknown.
    """
    if "directional" not in rows.columns:
        rows = rows.withColumn("directional", F.lit(False))
    both = resolved(resolved(rows, "source", refs, "s"), "target", refs, "t")
    bad = both.where(F.col("s").isNull() | F.col("t").isNull() | (F.col("s") == F.col("t")) | F.col("type").isNull() | ~F.col("type").isin(*TYPES)).select("source", "target", "type").take(5)
    if bad:
        raise InvalidArtifactError("relationships that can't be compiled: " + "; ".join(f"{r['source']} -{r['type']}-> {r['target']}" for r in bad), "relationships")
    strength = clamp01(F.coalesce(F.col("priority").cast("double"), F.lit(1.0)))
    base = both.select(F.col("s").alias("source"), F.col("t").alias("target"), "type", strength.alias("strength"), F.coalesce("provenance", F.lit("domain")).alias("provenance"), F.coalesce("directional", F.lit(False)).alias("directional"))
    back = base.where(F.col("type").isin(*SYMMETRIC) & ~F.col("directional")).select(F.col("target").alias("source"), F.col("source").alias("target"), "type", "strength", "provenance", "directional")
    return first_edges(base.withColumn("o", F.lit(0)).unionByName(back.withColumn("o", F.lit(1))))


def first_edges(rows: DataFrame) -> DataFrame:
    """One edge of each source, target and type: the given direction first, then the strongest."""
    return rows.where("source <> target").groupBy("source", "target", "type").agg(F.min_by(F.struct("strength", "provenance"), F.struct("o", -F.col("strength"), "provenance")).alias("e")).select("source", "target", "type", "e.strength", "e.provenance")


def filtered(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    return edges.where(F.col("type").isin(*(RUNTIME if types is None else types)))


def merged(graphs: list[DataFrame]) -> DataFrame:
    """The union of graphs: of equal edges the greatest strength, all provenances joined in order with +."""
    rows = None
    for i, g in enumerate(graphs):
        part = g.select("source", "target", "type", F.coalesce(F.col("strength").cast("double"), F.lit(1.0)).alias("strength"), F.coalesce("provenance", F.lit("")).alias("provenance"), F.lit(i).alias("g"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where(F.col("source") != F.col("target")).where(F.col("type").isin(*TYPES))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("g", "provenance"))), lambda x: x["provenance"])
    out = rows.groupBy("source", "target", "type").agg(F.max("strength").alias("strength"), F.array_join(F.filter(F.array_distinct(listed), lambda p: p != ""), "+").alias("provenance"))
    return out


def adjacency(edges: DataFrame) -> DataFrame:
    """edges with ord, their place in the source's list: strongest first, then type and target."""
    return edges.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("strength"), "type", "target")))


def relationship_id(source: Column, target: Column, type_: Column) -> Column:
    symmetric = type_.isin(*SYMMETRIC)
    return F.concat_ws(":", F.lit("rel"), type_, F.when(symmetric, F.least(source, target)).otherwise(source), F.when(symmetric, F.greatest(source, target)).otherwise(target))


def graph_counts(edges: DataFrame) -> DataFrame:
    pair = F.concat_ws("|", F.least("source", "target"), F.greatest("source", "target"), "type")
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct(pair).alias("pairs"), F.count_distinct("source").alias("sources"))
