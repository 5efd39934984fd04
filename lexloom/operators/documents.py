"""Documents as analysed rows: the index that every retriever reads."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.english import English
from lexloom.functions.text import STOP, canonical_id, is_stop, spaced, tokenize, tokens
from lexloom.functions.versions import MARK, compact_forms, dotted_spans, in_span, marked_tokens
from lexloom.operators.counting import unique


def last_wins(docs: DataFrame, id_column: str = "id", order: str = "seq") -> DataFrame:
    """One row of each id, the last in `order`; rows without an id go. One shuffle, combined before it."""
    keyed = docs.withColumn(id_column, canonical_id(F.col(id_column))).where(F.col(id_column) != "")
    others = [c for c in keyed.columns if c != id_column]
    return keyed.groupBy(id_column).agg(F.max_by(F.struct(*others), F.col(order)).alias("_row")).select(id_column, "_row.*")


def analysed(docs: DataFrame, morphology: English | None = None, title: str = "title", body: str = "body") -> DataFrame:
    """docs (id, title, body, perhaps lexical_frequency) with tokens, lemmas and what ranking needs of them."""
    english = morphology or English()
    out = docs
    if "lexical_frequency" not in out.columns:
        out = out.withColumn("lexical_frequency", F.lit(None).cast("map<string,double>"))
    out = out.select("id", F.coalesce(F.col(title).cast("string"), F.lit("")).alias("title"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"), F.map_filter("lexical_frequency", lambda _, v: ~F.isnan(v) & (v > 0) & (v < float("inf"))).alias("lexical_frequency"))
    out = out.withColumns({"title_marked": marked_tokens(F.col("title")), "body_tokens": tokens(F.col("body")), "dotted_spans": dotted_spans(F.col("title"))})
    out = out.withColumns({"title_tokens": F.transform("title_marked", lambda t: F.replace(t, F.lit(MARK), F.lit(""))), "body_lemmas": F.transform("body_tokens", english.lemma_column)})
    out = out.withColumns({
        "title_lemmas": F.transform("title_tokens", english.lemma_column),
        "independent_tokens": F.filter("title_marked", lambda t: ~in_span(t)),
        "non_stop_title": F.filter("title_tokens", lambda t: ~is_stop(t)),
        "first_token": F.coalesce(F.get("title_tokens", F.lit(0)), F.lit("")),
        "normalized_title": F.array_join("title_tokens", " "),
        "version_forms": compact_forms(F.col("dotted_spans")),
    })
    out = out.withColumns({
        "independent_tokens": F.transform("independent_tokens", lambda t: F.replace(t, F.lit(MARK), F.lit(""))),
        "independent_lemmas": F.transform(F.filter(F.arrays_zip("title_marked", "title_lemmas"), lambda z: ~in_span(z["title_marked"])), lambda z: z["title_lemmas"]),
    })
    return out.withColumns({"title_text": spaced(F.col("title_tokens")), "title_lemma_text": spaced(F.col("title_lemmas")), "body_text": spaced(F.col("body_tokens")), "body_lemma_text": spaced(F.col("body_lemmas"))})


def vocabulary(index: DataFrame) -> DataFrame:
    """(term, in_title, in_surface): title tokens and lemmas are the lexicon, title and body tokens complete prefixes."""
    kinds = (("title_tokens", True, True), ("title_lemmas", True, False), ("body_tokens", False, True))
    rows = None
    for column, lexicon, surface in kinds:
        part = index.select(F.explode(F.array_distinct(column)).alias("term"), F.lit(lexicon).alias("in_title"), F.lit(surface).alias("in_surface"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("term").agg(F.max("in_title").alias("in_title"), F.max("in_surface").alias("in_surface"))


def lexical_frequency(docs: DataFrame, morphology: English | None = None, least_n: int = 1, most_n: int = 2, least_count: int = 2, body: str = "body") -> DataFrame:
    """(id, gram, n): how often each document's body has an n-gram of lemmas without stop words, for n-grams that
    all bodies together have least_count times."""
    for name, value in (("least_n", least_n), ("most_n", most_n), ("least_count", least_count)):
        if not isinstance(value, int) or value < 1:
            raise ValueError(f"{name} must be a positive integer")
    if most_n < least_n:
        raise ValueError("most_n must not be less than least_n")
    english = morphology or English()
    kind = dict(docs.dtypes)["id"]

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lemmas: dict[str, str] = {}
        ids, held, ns = [], [], []
        for frame in frames:
            for at, text in zip(frame["id"], frame["text"]):
                stream = []
                for t in tokenize(text):
                    lemma = lemmas.get(t)
                    if lemma is None:
                        if len(lemmas) > 1_000_000:
                            lemmas.clear()
                        lemma = lemmas[t] = english.lemma(t)
                    if lemma and lemma not in STOP:
                        stream.append(lemma)
                grams: Counter = Counter()
                for n in range(least_n, most_n + 1):
                    grams.update([t for t in stream if len(t) >= 2] if n == 1 else map(" ".join, zip(*(stream[i:] for i in range(n)))))
                ids += [at] * len(grams)
                held += grams
                ns += grams.values()
                if len(ids) > 100_000:
                    yield pd.DataFrame({"id": ids, "gram": held, "n": ns})
                    ids, held, ns = [], [], []
        if ids:
            yield pd.DataFrame({"id": ids, "gram": held, "n": ns})

    counts = docs.select("id", F.col(body).cast("string").alias("text")).mapInPandas(counted, f"id {kind}, gram string, n bigint")
    if not unique(docs):
        counts = counts.groupBy("id", "gram").agg(F.sum("n").alias("n"))
    if least_count == 1:
        return counts
    # One shuffle by n-gram serves the sums and what is kept.
    return counts.withColumn("all", F.sum("n").over(Window.partitionBy("gram"))).where(F.col("all") >= least_count).select("id", "gram", "n")


def with_lexical_frequency(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """docs with the map lexical_frequency; documents without kept n-grams have an empty one."""
    maps = counts.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gram", F.col("n").cast("double").alias("n"))))).alias("lexical_frequency"))
    return docs.drop("lexical_frequency").join(maps, "id", "left").withColumn("lexical_frequency", F.coalesce("lexical_frequency", F.create_map().cast("map<string,double>")))
