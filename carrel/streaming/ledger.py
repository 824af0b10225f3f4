"""Streaming forms: running earnings over a stream of ledger events, and continuous ingest into the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_credits(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, credits, total) of purchases by day of a stream or table of events(ts, event_type, value); late rows beyond delay are left out of a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("event_type") == "purchase")
    if e.isStreaming:
        e = e.withWatermark("ts", delay)
    g = e.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("credits"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("day"), "credits", "total")


def running_earnings(purchases: DataFrame) -> DataFrame:
    """(owner, earned) so far, in update mode."""
    return purchases.groupBy("owner").agg(F.sum("amount").alias("earned"))


def ingest(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of catalogue rows to a path. Each batch has a folder of its own, so a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(state: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the whole state of a running aggregate as a table at a path. Each batch overwrites it, so a batch that is run again does no harm."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return state.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
