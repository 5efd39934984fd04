"""Searches as a stream in which the newest query of a session wins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_OUT = "session string, generation bigint, query string, cleared boolean"


def latest(batch: DataFrame) -> DataFrame:
    """(session, generation, query, cleared) of the newest keystroke of each session; an empty query clears."""
    newest = batch.groupBy("session").agg(F.max_by("query", "generation").alias("query"), F.max("generation").alias("generation"))
    return newest.select("session", "generation", "query", (F.trim(F.coalesce("query", F.lit(""))) == "").alias("cleared"))


def session_stats(events: DataFrame) -> DataFrame:
    """(session, submitted, coalesced, cleared, published): what becomes of the keystrokes of a session in one batch."""
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("generation")))
    rows = events.withColumn("n", rank).withColumn("empty", F.trim(F.coalesce("query", F.lit(""))) == "")
    return rows.groupBy("session").agg(F.count(F.lit(1)).alias("submitted"), F.count_if(F.col("n") > 1).alias("coalesced"), F.count_if((F.col("n") == 1) & F.col("empty")).alias("cleared"), F.count_if((F.col("n") == 1) & ~F.col("empty")).alias("published"))


class LatestWins(StatefulProcessor):
    """Keeps the newest generation of each session: what arrives late, after a newer one, is not passed on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("generation", "generation bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = self.seen.get()[0] if self.seen.exists() else -1
        best, query = before, None
        for frame in rows:
            newest = frame.loc[frame["generation"].idxmax()]
            if newest["generation"] > best:
                best, query = int(newest["generation"]), newest["query"]
        if best > before:
            self.seen.update((best,))
            yield pd.DataFrame({"session": [key[0]], "generation": [best], "query": [query], "cleared": [not str(query or "").strip()]})

    def close(self) -> None:
        pass


def latest_stream(events: DataFrame) -> DataFrame:
    """A stream of (session, generation, query) reduced to what is newer than all before, across micro-batches.

    Runs on the RocksDB state store, which spark.sql.streaming.stateStore.providerClass must name.
    """
    return events.groupBy("session").transformWithStateInPandas(LatestWins(), _OUT, "Update", "none")


def serve(events: DataFrame, search: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Answers each micro-batch: only the newest query of a session is searched, empty ones clear it."""

    def handle(batch: DataFrame, number: int) -> None:
        newest = latest(batch).persist()
        asked = newest.where(~F.col("cleared")).select(F.concat_ws("#", "session", "generation").alias("query_id"), F.col("query").alias("raw"))
        publish(search(asked), number)
        newest.unpersist()

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
