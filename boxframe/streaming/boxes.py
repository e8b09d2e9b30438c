"""Streams of boxes and events. Each takes a streaming or batch DataFrame alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sinks import artifact
from ..sources import documents


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; the watermark bounds the state (and is ignored in batch)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Gap clustering over time: a user's events less than a gap apart.

    On a stream an event counts while ts + gap is above the watermark, and may then reach back by a gap to a session that ended before it. So the
    watermark waits for both, and events are counted by instant first: that step drops by ts what is late, which session windows do by their end.
    """
    each = events.withColumn("n", F.lit(1))
    if events.isStreaming:
        each = events.withWatermark("ts", f"{gap} {late}").groupBy("user_id", "ts").agg(F.count("*").alias("n"))
    w = each.groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return w.agg(F.sum("n").alias("n")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def latest(feed: DataFrame) -> DataFrame:
    """The last state of every node of an added/changed feed, for use in foreachBatch or on a finished feed."""
    return feed.groupBy("url", "tag", "x", "y").agg(F.max_by(F.struct("text", "mutation_type", "t_ms"), F.struct("t_ms", "text")).alias("v")).select("url", "tag", "x", "y", "v.*")


def committed(contents: DataFrame, out: str, parse: Callable[[DataFrame], DataFrame] = documents.parse) -> DataStreamWriter:
    """A writer that commits the artifacts of a stream of doc_id and content, a micro-batch at a time; repeats are not parsed again."""

    def each(batch: DataFrame, number: int) -> None:
        artifact.commit(batch, out, number, parse=parse)

    return contents.writeStream.foreachBatch(each)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Starts committing the artifacts of new files of a folder; a file's path hash is its doc_id, its content decides whether it is new."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", 1000).load(folder).select(F.xxhash64("path").alias("doc_id"), "content")
    return committed(files, out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
