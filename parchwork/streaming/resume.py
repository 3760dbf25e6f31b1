"""Streams of incoming documents, and work that goes on where it stopped (SCH-5, SCH-6).

Structured Streaming keeps what has been done in its checkpoint, so a restart resumes; on a batch table an anti-join with finished
chunks does the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchwork.plans.session import shared_dir


def remaining_chunks(planned: DataFrame, finished: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_index, ...) that aren't finished."""
    return planned.join(finished.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_anti")


def rescued_pages(converted: DataFrame, direct: DataFrame, from_page: DataFrame) -> DataFrame:
    """`converted` pages (doc_id, page_no, page) and, for documents that stopped at from_page (doc_id, start_page), the rest from the direct text."""
    rest = direct.join(from_page, "doc_id").where("page_no >= start_page").select("doc_id", "page_no", "page")
    return converted.select("doc_id", "page_no", "page").join(from_page, "doc_id", "left").where("start_page is null or page_no < start_page").select("doc_id", "page_no", "page").unionByName(rest)


def stream_documents(spark: SparkSession, path: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Parquet files that arrive at `path` through `work` to `target`.

    Each micro-batch is a folder named by its number and written over if it is done again, so a restart neither loses nor repeats rows.
    """
    source = spark.readStream.schema(schema).parquet(path)

    def store(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/stream")
    return (query.trigger(availableNow=True) if available_now else query.trigger(processingTime="10 seconds")).start()


def progress(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by type and window of their time, streaming or not; a stream drops what is later than `late`."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", F.round("total", 6).alias("total"))
