"""Cleaning of documents as they arrive, and running counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.cleaning import cleaned, exploded, without_back_matter
from lodestone.sources.sinks import append_new


def clean_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "id string, text string"):
    """Starts a query that cleans new Parquet files of texts and appends those whose id is new."""

    def one(batch: DataFrame, _: int) -> None:
        append_new(cleaned(without_back_matter(exploded(batch))).select("id", "text"), target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, event_type, n) of a stream or table with columns ts and event_type; events later than `late` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
