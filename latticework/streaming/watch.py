"""Incremental ingest of image folders and windows over event streams (additions; nothing here is batch parity)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images as I
from ..plans.config import Config
from ..sources import images as S

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, root: str, cfg: Config, out: str, checkpoint: str):
    """Process files that have arrived since the last run, then stop; restart-safe by its checkpoint."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(root)
    rows = files.select(F.col("path").alias("source"), F.col("length").alias("byte_size"), "content").where(F.lower("source").endswith(".png"))
    done = I.process(S.decode(rows), cfg, with_pixels=False)
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; state older than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    agg = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def each_batch(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """Run a function for each micro-batch of what is there now."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
