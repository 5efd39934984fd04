"""How good a ranking is: NDCG, MRR and recall against judgments, and checks of neighbour graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.errors import InvalidArtifactError

RELEVANT = 2


def query_metrics(ranked: DataFrame, judgments: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query_id, ndcg@k, recall@k ..., mrr) of ranked (query_id, id, rank) by judgments (query_id, id, grade).

    The gain of a grade is 2 ** grade - 1, discounted by log2(rank + 1); recall and MRR count grades of RELEVANT or more.
    A query without gain has no NDCG, one without relevant documents neither recall nor MRR.
    """
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    ideal = judgments.withColumn("best", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")))
    ideals = ideal.groupBy("query_id").agg(F.sum((F.col("grade") >= RELEVANT).cast("int")).alias("relevant"), *[F.sum(F.when(F.col("best") <= k, gain(F.col("grade")) / F.log2(F.col("best") + 1)).otherwise(0.0)).alias(f"ideal{k}") for k in ks])
    hits = ranked.select("query_id", "id", "rank").join(judgments, ["query_id", "id"])
    good = F.col("grade") >= RELEVANT
    sums = hits.groupBy("query_id").agg(F.min(F.when(good, F.col("rank"))).alias("first"), *[F.sum(F.when(F.col("rank") <= k, gain(F.col("grade")) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg{k}") for k in ks], *[F.sum((good & (F.col("rank") <= k)).cast("int")).alias(f"found{k}") for k in ks])
    rows = ideals.join(sums, "query_id", "left")
    columns = [F.when(F.col(f"ideal{k}") > 0, F.coalesce(f"dcg{k}", F.lit(0.0)) / F.col(f"ideal{k}")).alias(f"ndcg_{k}") for k in ks]
    columns += [F.when(F.col("relevant") > 0, F.coalesce(f"found{k}", F.lit(0)) / F.col("relevant")).alias(f"recall_{k}") for k in ks]
    return rows.select("query_id", *columns, F.when(F.col("relevant") > 0, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """Means over the queries that each metric is defined for."""
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(c) for c in names])


def check_judgments(judgments: DataFrame, queries: DataFrame, docs: DataFrame) -> None:
    """Raises InvalidArtifactError unless every query judges every document once, with a grade of 0 to 3."""
    wanted = queries.select("query_id").crossJoin(docs.select("id"))
    tests = (
        ("grades must be 0 to 3", judgments.where("grade is null or grade not between 0 and 3")),
        ("judged twice", judgments.groupBy("query_id", "id").count().where("count > 1")),
        ("unjudged", wanted.join(judgments, ["query_id", "id"], "left_anti")),
        ("unknown", judgments.join(wanted, ["query_id", "id"], "left_anti")),
    )
    for what, rows in tests:
        found = rows.take(3)
        if found:
            raise InvalidArtifactError(f"{what}: " + ", ".join(f"{r['query_id']}/{r['id']}" for r in found), "judgments")


def graph_metrics(graph: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """One row: mrr and recall of the first k neighbours of graph (source, target, rank) for expected (source, target)."""
    hits = expected.join(graph.where(F.col("rank") <= k), ["source", "target"], "left").groupBy("source").agg(F.min("rank").alias("first"), F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"))
    return hits.agg(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("sources"))


def violations(graph: DataFrame, negatives: DataFrame) -> DataFrame:
    """Edges that must not be."""
    return graph.join(negatives.select("source", "target"), ["source", "target"], "left_semi")


def sparsity(graph: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: documents, edges, documents without a neighbour, and the median number of neighbours."""
    degree = docs.select("id").join(graph.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return degree.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("edges"), F.count_if(F.col("n") == 0).alias("isolated"), F.percentile("n", F.lit(0.5)).alias("median"))
