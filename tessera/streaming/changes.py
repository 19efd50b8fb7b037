"""Streams: a feed of changed files applied to the store, and a live view of usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import first_by
from ..sources.rollup import Rollup
from ..sources.store import Store


def apply_changes(feed: DataFrame, store: Store, table: str, checkpoint: str, key: str = "file_id") -> StreamingQuery:
    """Upsert each batch of the feed (key, seq, deleted, other columns) into a table; the highest seq of a key wins.

    A batch that is run again after a failure rewrites the same keys, so the result is the same.
    """

    def put(batch: DataFrame, _: int) -> None:
        last = first_by(batch.withColumn("_o", -F.col("seq")), key, "_o").drop("_o", "seq")
        store.replace_files(table, last.where("not deleted").drop("deleted"), key, last.select(key))

    return feed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_facts(feed: DataFrame, rollup: Rollup, checkpoint: str) -> StreamingQuery:
    """Keep aggregates up to date with a feed of facts (the rollup's columns, seq, deleted); the highest seq of an owner wins.

    Batches are numbered by the stream, so one that is run again after a failure counts once.
    """

    def put(batch: DataFrame, number: int) -> None:
        last = first_by(batch.withColumn("_o", -F.col("seq")), rollup.owner, "_o")
        rollup.apply(last.where("not deleted"), number, last.select(rollup.owner))

    return feed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_by_window(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """provider, window, n, cost; state older than the watermark is dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window), "provider").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
    return g.select("provider", F.col("window.start").alias("start"), "n", "cost")
