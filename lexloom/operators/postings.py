"""The inverted index and ranked retrieval over it: BM25, prefixes, titles and versions, all as joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import all_digits, allow_prefix

K1, B = 1.2, 0.75
TITLE_BOOST = 4.0
CANDIDATES = 200
PREFIX_CAP = 800
PREFIX_TERMS = 64
#: Weight of a posting by field; prefixes of title and body tokens weigh less.
WEIGHTS = {"title": TITLE_BOOST, "body": 1.0, "title_lemma": 0.6 * TITLE_BOOST, "body_lemma": 0.5}
PREFIX_WEIGHTS = {"title": 0.5 * TITLE_BOOST, "body": 0.4}
_FIELDS = {"title": "title_tokens", "body": "body_tokens", "title_lemma": "title_lemmas", "body_lemma": "body_lemmas"}


def _in_field(name: str):
    return lambda t: F.struct(F.lit(name).alias("field"), t.alias("term"))


def postings(index: DataFrame) -> DataFrame:
    """(field, term, id, tf, dl): one shuffle for all four fields; dl is the length of the field's text."""
    parts = [F.transform(F.col(c), _in_field(f)) for f, c in _FIELDS.items()]
    rows = index.select("id", F.size("title_tokens").alias("title_dl"), F.size("body_tokens").alias("body_dl"), F.explode(F.concat(*parts)).alias("p"))
    dl = F.when(F.startswith(F.col("p.field"), F.lit("title")), F.col("title_dl")).otherwise(F.col("body_dl"))
    return rows.groupBy(F.col("p.field").alias("field"), F.col("p.term").alias("term"), "id").agg(F.count(F.lit(1)).alias("tf"), F.max(dl).alias("dl"))


def term_stats(posting: DataFrame) -> DataFrame:
    return posting.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: the number of documents and the mean lengths of titles and bodies."""
    return index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("title_tokens")), F.lit(0.0)).alias("title_avg"), F.coalesce(F.avg(F.size("body_tokens")), F.lit(0.0)).alias("body_avg"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_tf(tf: Column, dl: Column, average: Column) -> Column:
    norm = 1 - B + B * dl / F.when(average > 0, average).otherwise(F.lit(1.0))
    return tf * (K1 + 1) / (tf + K1 * norm)


def query_forms(analysed_queries: DataFrame) -> DataFrame:
    """(query_id, form, kind, single): distinct retrieval forms; kind is title, configured-equivalence."""
    t = F.flatten(F.transform("tokens", lambda x: F.array(F.struct(x["normalized"].alias("form"), F.lit("token").alias("kind")), F.struct(x["lemma"].alias("form"), F.lit("lemma").alias("kind")))))
    c = F.flatten(F.transform("concepts", lambda x: F.transform(F.array_distinct(F.concat(F.array(x["id"]), x["forms"])), lambda f: F.struct(f.alias("form"), F.when(x["kind"] == "acronym", "acronym").otherwise("term").alias("kind")))))
    return analysed_queries.select("query_id", F.explode(F.array_distinct(F.concat(t, c))).alias("f")).select("query_id", "f.form", "f.kind").where("form <> ''").distinct()


def bm25_scores(forms: DataFrame, posting: DataFrame, stats: DataFrame, prefixes: bool = True) -> DataFrame:
    """(query_id, id, score, sources): BM25 sums of forms (query_id, form, kind) over the posting's fields and prefixes.

    Only postings of the asked terms are read: they are joined on the term, document frequencies likewise.
    """
    asked = forms.select("form").distinct()
    df = posting.join(asked, posting["term"] == asked["form"], "left_semi").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    exact = forms.withColumnRenamed("form", "term").join(df, "term").withColumn("weight", _weight(WEIGHTS)).withColumn("source", _source())
    columns = ["query_id", "field", "term", "df", "weight", "source"]
    wanted = exact.select(*columns)
    if prefixes:
        wanted = wanted.unionByName(_prefix_terms(forms, posting).select(*columns))
    hits = wanted.join(posting.select("field", "term", "id", "tf", "dl"), ["field", "term"]).crossJoin(F.broadcast(stats))
    average = F.when(F.startswith(F.col("field"), F.lit("title")), F.col("title_avg")).otherwise(F.col("body_avg"))
    score = F.col("weight") * idf(F.col("df"), F.col("n")) * bm25_tf(F.col("tf"), F.col("dl"), average)
    return hits.groupBy("query_id", "id").agg(F.sum(score).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def _prefix_terms(forms: DataFrame, posting: DataFrame) -> DataFrame:
    """Terms of titles and bodies that a form begins, PREFIX_TERMS of each form and field in order."""
    terms = posting.where(F.col("field").isin("title", "body")).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    starts = forms.where(~all_digits(F.col("form")) & (F.length("form") >= 3) & (F.col("kind") != "acronym"))
    pairs = starts.withColumn("block", F.substring("form", 1, 3)).join(terms.withColumn("block", F.substring("term", 1, 3)), "block").where((F.col("term") != F.col("form")) & allow_prefix(F.col("form"), F.col("term")))
    rank = F.row_number().over(Window.partitionBy("query_id", "form", "kind", "field").orderBy("term"))
    return pairs.withColumn("rn", rank).where(F.col("rn") <= PREFIX_TERMS).withColumn("weight", _weight(PREFIX_WEIGHTS)).withColumn("source", F.when(F.col("field") == "title", "title-token-prefix").otherwise("indexed-lexical"))


def _weight(weights: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("field"))


def _source() -> Column:
    return (
        F.when(F.col("field").isin("title_lemma", "body_lemma"), "morphology")
        .when((F.col("field") == "title") & (F.col("kind") == "acronym"), "configured-equivalence")
        .when(F.col("field") == "title", "title-token")
        .otherwise("body-lexical")
    )


def title_scores(queries: DataFrame, index: DataFrame, cap: int = PREFIX_CAP) -> DataFrame:
    """(query_id, id, score, sources) of exact titles (50), title prefixes (8 by tightness, capped) and versions (12 a token)."""
    q = queries.select("query_id", "query_norm", "tokens", "query_spans")
    docs = index.select("id", "normalized_title", "version_forms", "dotted_spans")
    exact = q.join(docs, (q["query_norm"] == docs["normalized_title"]) & (q["query_norm"] != "")).select("query_id", "id", F.lit(50.0).alias("s"), F.lit("exact-title").alias("source"))
    first = lambda c: F.substring(c, 1, 1)
    starts = q.where("query_norm <> ''").withColumn("block", first(F.col("query_norm"))).join(docs.withColumn("block", first(F.col("normalized_title"))), "block").where(F.startswith("normalized_title", F.col("query_norm")))
    tight = F.length("query_norm") / F.length("normalized_title")
    near = starts.withColumn("t", tight).withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("t"), "id"))).where(F.col("rn") <= cap).select("query_id", "id", (8 * F.col("t")).alias("s"), F.lit("title-prefix").alias("source"))
    forms = docs.select("id", F.explode(F.concat(F.transform("version_forms", lambda v: F.concat(F.lit("c"), v)), F.transform(F.array_distinct("dotted_spans"), lambda v: F.concat(F.lit("d"), v)))).alias("v"))
    digits = F.transform(F.filter("tokens", lambda t: all_digits(t["normalized"])), lambda t: F.concat(F.lit("c"), t["normalized"]))
    asked = q.select("query_id", F.explode(F.concat(digits, F.transform("query_spans", lambda s: F.concat(F.lit("d"), s)))).alias("v"))
    version = asked.join(forms, "v").select("query_id", "id", F.lit(12.0).alias("s"), F.lit("version").alias("source"))
    rows = exact.unionByName(near).unionByName(version)
    return rows.groupBy("query_id", "id").agg(F.sum("s").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


MUST_KEEP = ("exact-title", "configured-equivalence", "version")


def budgeted(scored: DataFrame, k: int = CANDIDATES, cap: int = PREFIX_CAP) -> DataFrame:
    """The must-keep hits of each query, contextual ones up to `cap` by quality, and the k best of the rest."""
    must = F.arrays_overlap("sources", F.array(*[F.lit(s) for s in MUST_KEEP]))
    contextual = F.array_contains("sources", "contextual-title-prefix")
    kind = F.when(must, 0).when(contextual, 1).otherwise(2)
    order = Window.partitionBy("query_id", "kind").orderBy(F.when(F.col("kind") == 1, F.col("quality")).otherwise(F.col("score")).desc(), "id")
    ranked = (scored if "quality" in scored.columns else scored.withColumn("quality", F.lit(0.0))).withColumn("kind", kind).withColumn("rn", F.row_number().over(order))
    return ranked.where((F.col("kind") == 0) | ((F.col("kind") == 1) & (F.col("rn") <= cap)) | (F.col("rn") <= k)).drop("kind", "rn")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def saturation(n: float) -> float:
    x = math.log1p(max(0.0, n))
    return round(x / (1 + x), 4)
