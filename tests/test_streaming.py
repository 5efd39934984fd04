"""Latest-wins sessions in batches and across micro-batches."""

from __future__ import annotations

from lexloom.streaming.latest_wins import latest, latest_stream, serve, session_stats

SCHEMA = "session string, generation bigint, query string"


def test_a_batch(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, ""), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, None)], SCHEMA)
    assert {tuple(r) for r in latest(rows).collect()} == {("a", 3, "", True), ("b", 1, "z", False), ("c", 1, None, True)}
    assert {tuple(r) for r in session_stats(rows).collect()} == {("a", 3, 2, 1, 0), ("b", 1, 0, 0, 1), ("c", 1, 0, 1, 0)}


def test_micro_batches(spark, tmp_path):
    source, out = tmp_path / "in", []
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "")], SCHEMA).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    search = lambda asked: asked.selectExpr("query_id", "upper(raw) AS answer")
    publish = lambda rows, _: out.extend(tuple(r) for r in rows.collect())
    serve(stream, search, publish, str(tmp_path / "c1"), once=True).awaitTermination(60)
    assert out == [("a#2", "Y")]


def test_late_keystrokes_are_not_passed_on(spark, tmp_path):
    source, seen = tmp_path / "in", []

    def run():
        stream = latest_stream(spark.readStream.schema(SCHEMA).parquet(str(source)))
        q = stream.writeStream.outputMode("update").foreachBatch(lambda rows, _: seen.extend(tuple(r) for r in rows.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(90)

    spark.createDataFrame([("a", 5, "new")], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    run()
    spark.createDataFrame([("a", 4, "late"), ("b", 1, "x")], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert sorted(seen) == [("a", 5, "new", False), ("b", 1, "x", False)]
