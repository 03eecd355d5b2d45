"""New files as a stream: each file is seen once, whatever is interrupted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.files import BINARY, basename


def new_files(spark: SparkSession, folder: str, glob: str = "*.pdf", per_batch: int = 1000) -> DataFrame:
    """A streaming table path, filename, content, hash, modificationTime."""
    found = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(folder)
    return found.select("path", basename(F.col("path")).alias("filename"), "content", F.sha2("content", 256).alias("hash"), "modificationTime")


def drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand all that is there now to handle(batch, id), then stop; a later call goes on from there."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values by window and type, for streams and tables alike (beyond the document engine)."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n_events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("sum_cents"))
