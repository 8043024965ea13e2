"""Structured Streaming: folder ingestion, the change log, and event-time windows (the last as an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def folder(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder and its subfolders, content hashed where it is read; unreadable ones are passed over."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), "content")


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hands each batch to `handle`; once over what is there, or every so often ("5 minutes")."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def change_log(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, op) between two generations of a store, by rev: put or remove."""
    a, b = before.select(F.col(key).alias("k"), F.col("rev").alias("ra")), after.select(F.col(key).alias("k"), F.col("rev").alias("rb"))
    rows = a.withColumn("ina", F.lit(True)).join(b.withColumn("inb", F.lit(True)), "k", "full_outer")
    op = F.when(F.col("inb").isNull(), "remove").when(F.col("ina").isNull() | ~F.col("ra").eqNullSafe(F.col("rb")), "put")
    return rows.select(F.col("k").alias(key), op.alias("op")).where("op is not null")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events per type and tumbling window of event time; late rows beyond the watermark are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
