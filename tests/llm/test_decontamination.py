"""Short items, rounds, repeats and clashing columns of decontamination."""

from __future__ import annotations

from lexloom.llm import decontamination


def test_items_of_a_few_letters_remove_nothing(spark):
    docs = spark.createDataFrame([(1, "a plain text of some words"), (2, None), (3, "it holds the long question whole, and more")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "a"), (8, "  tEXt "), (9, None), (10, "The Long  question whole")], "item_id bigint, text string")
    assert sorted(x["doc_id"] for x in decontamination.decontaminate(docs, bench).collect()) == [1, 2]
    assert sorted(x["item_id"] for x in decontamination.too_short(bench).collect()) == [7, 8, 9]
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == 3


def test_rounds_keep_rows_and_columns(spark):
    names = ("hits", "row", "found", "found_hits")
    item = "which of the rivers is the longest one of all"
    docs = spark.createDataFrame([(i, t, *names) for i, t in ((1, item), (1, item), (2, None), (3, ""), (4, "x " * 50 + item.replace("longest", "lungest")))], "doc_id bigint, text string, hits string, row string, found string, found_hits string")
    bench = spark.createDataFrame([(k, f"{item} {k}" if k else item) for k in range(6)], "item_id bigint, text string")
    for most in (1 << 20, 60):
        kept = decontamination.decontaminate(docs, bench, chunk_chars=most)
        assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [2, 3]
        found = decontamination.benchmark_hits(docs, bench, out="here", chunk_chars=most).collect()
        assert len(found) == 5 and {(x["doc_id"], h["item_id"], h["distance"]) for x in found for h in x["here"]} == {(i, k, d + (2 if k else 0)) for i, d in ((1, 0), (4, 1)) for k in range(6)}
