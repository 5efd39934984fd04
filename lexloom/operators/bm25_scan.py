"""BM25 of whole query batches in one pass: texts are counted for asked words only, scored in blocks, and the k best of each query stay."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.durable import written
from lexloom.functions.text import tokenize
from lexloom.operators.postings import K1, WEIGHTS, B

#: Documents, and cells of documents by asked words, that a task scores at once.
ROWS, CELLS = 1024, 8_388_608


def best(docs: DataFrame, forms: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, id, score): at least the k best documents (id, title, body), each one row, for every query's forms (query_id, form),
    and no more than k from a task. Queries and their words are held by every task; documents are not."""
    asked = sorted({(r["query_id"], r["form"]) for r in forms.select("query_id", "form").collect()})
    names, terms = sorted({q for q, _ in asked}), sorted({t for _, t in asked})
    at, kinds = {t: i for i, t in enumerate(terms)}, dict(docs.dtypes)["id"]
    schema = f"query_id string, id {kinds}, score double"
    if not asked:
        return docs.sparkSession.createDataFrame([], schema)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {"id": frame["id"].tolist()}
            for f in ("title", "body"):
                split = [tokenize(x) for x in frame[f]]
                counts = [Counter(filter(None.__ne__, map(at.get, ws))) for ws in split]
                out |= {f"{f}_dl": [len(ws) for ws in split], f"{f}_at": [list(c) for c in counts], f"{f}_tf": [list(c.values()) for c in counts]}
            if len(frame):
                yield pd.DataFrame(out)

    fields = ", ".join(f"{f}_dl int, {f}_at array<int>, {f}_tf array<int>" for f in ("title", "body"))
    counted = written(docs.select("id", "title", "body").mapInPandas(count, f"id {kinds}, {fields}"), "asked-words")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("title_dl").alias("title"), F.avg("body_dl").alias("body")).first()
    idf = {}
    for f in ("title", "body"):
        df = np.zeros(len(terms))
        for r in counted.select(F.explode(f"{f}_at").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        idf[f] = WEIGHTS[f] * np.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
    average = {f: stats[f] or 1.0 for f in ("title", "body")}
    place = {q: i for i, q in enumerate(names)}
    pairs = np.array([(at[t], place[q]) for q, t in asked])
    rows = max(1, min(ROWS, CELLS // len(terms)))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asks = np.zeros((len(terms), len(names)))
        asks[pairs[:, 0], pairs[:, 1]] = 1.0
        low, kept = np.full(len(names), np.nextafter(0.0, 1.0)), None
        for whole in frames:
            for begin in range(0, len(whole), rows):
                frame = whole.iloc[begin : begin + rows]
                weights = np.zeros((len(frame), len(terms)))
                for f in ("title", "body"):
                    row = np.repeat(np.arange(len(frame)), frame[f"{f}_at"].map(len).to_numpy())
                    t, tf = (np.concatenate(frame[f"{f}_{c}"].tolist()).astype(np.int64) for c in ("at", "tf"))
                    norm = 1 - B + B * frame[f"{f}_dl"].to_numpy()[row] / average[f]
                    weights[row, t] += idf[f][t] * (tf * (K1 + 1) / (tf + K1 * norm))
                s = (weights @ asks).T
                q, d = np.nonzero(s >= low[:, None])
                found = pd.DataFrame({"q": q, "id": frame["id"].to_numpy()[d], "score": s[q, d]})
                found["key"] = np.round(found["score"], digits)
                found = (found if kept is None else pd.concat([kept, found], ignore_index=True)).sort_values(["q", "key", "id"], ascending=[True, False, True])
                nth = found.groupby("q").cumcount()
                kept, last = found[nth < k], found[nth == k - 1]
                low[last["q"].to_numpy()] = np.maximum(low[last["q"].to_numpy()], last["key"].to_numpy() - 10.0**-digits)
        if kept is not None and len(kept):
            yield pd.DataFrame({"query_id": [names[i] for i in kept["q"]], "id": kept["id"].tolist(), "score": kept["score"].to_numpy()})

    return counted.mapInPandas(score, schema)
