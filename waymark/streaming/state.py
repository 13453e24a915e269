"""Queues and counts as streams: sightings by key, event-time windows whose state ends, and draining a stream within a time.

A stream's batches go to a log of changes: each batch writes the rows of its own keys to a folder by its number, so a batch
that runs again overwrites only itself, and what it writes is in proportion to the keys it touches. A reader merges the log by key.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.store import discard, shared_folder


def parquet_stream(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    """The rows of a parquet file or folder as a stream, so many files to a batch."""
    schema = spark.read.parquet(path).schema
    # A source must be a folder or a pattern; this one fits that name alone.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path[:-1]}[{path[-1]}]")


class Changes:
    """The log of changes of a stream in a folder that all executors share; a new one has a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def take(self, stream: DataFrame, mode: str = "append", made: Callable[[DataFrame], DataFrame] = lambda batch: batch, seconds: float | None = None) -> bool:
        """Takes in what the stream has: made() of each batch is written. False if the time (X6) was up before all was taken.

        What is left then, and a batch that was stopped, is taken by the next call with the same folder; nothing is lost or taken twice.
        """
        began, late = time.monotonic(), threading.Event()

        def keep(batch: DataFrame, number: int) -> None:
            if seconds is not None and time.monotonic() - began > seconds:
                late.set()
                raise _TimeIsUp
            made(batch).withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/changes/{number}")

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            if not late.is_set():
                raise
        return not late.is_set()

    def rows(self, schema) -> DataFrame:
        """All rows of the log, with _batch."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/changes")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema).withColumn("_batch", F.lit(0).cast("long"))
        return self.spark.read.option("recursiveFileLookup", "true").schema(self.spark.createDataFrame([], schema).withColumn("_batch", F.lit(0).cast("long")).schema).parquet(f"{self.folder}/changes")

    def latest(self, schema, keys: Sequence[str]) -> DataFrame:
        """For each key the row that was written last."""
        rest = [f.name for f in schema.fields if f.name not in keys]
        return self.rows(schema).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_s")).select(*keys, "_s.*")

    def drop(self) -> None:
        """Removes the log, with the stream's state and offsets."""
        discard(self.spark, self.folder)


class _TimeIsUp(Exception):
    pass


def sightings(batch: DataFrame, keys: Sequence[str], when: str, row_id: str) -> DataFrame:
    """Of a batch for each key the row that came first, how often the key came, and when last. Merged by seen()."""
    return batch.groupBy(*keys).agg(F.min(F.struct(F.col(when).alias("at"), F.col(row_id).alias("id"))).alias("first"), F.count(F.lit(1)).alias("times"), F.max(when).alias("last_seen"))


def seen(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sightings of all batches: content that is seen again keeps its first row and refreshes its time. No state is held between batches."""
    merged = changes.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("times").alias("times"), F.max("last_seen").alias("last_seen"))
    return merged.select(*keys, F.col("first.id").alias("first_id"), "times", "last_seen")


def windowed_counts(stream: DataFrame, when: str, keys: Sequence[str], values: dict[str, Column], length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sums of values by key and tumbling window, in update or append mode.

    A window's state ends when the watermark has passed it: in append mode it is written then, and rows later than that count in neither mode.
    """
    rows = stream.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late).groupBy(F.window(when, length), *keys)
    out = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in values.items()])
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", *values)
