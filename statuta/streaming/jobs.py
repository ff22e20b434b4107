"""Streams over the event table and the incremental posting index. Event time is `ts`; the watermark is ten minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.retrieval import postings

WATERMARK = "10 minutes"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream from a folder or file of Parquet."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    window = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width), "event_type")
    return window.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    window = events.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return window.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_events(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything available now into Parquet, exactly once by the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def index_batches(documents: DataFrame, out: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> None:
    """Adds the postings of each batch of new documents to an index, one folder a batch (a batch that is run again replaces its own)."""

    def add(batch: DataFrame, number: int) -> None:
        postings(batch, key, text).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
