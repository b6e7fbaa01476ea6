"""An extension beyond the batch operators: denied requests of each role in event-time windows, over a growing audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.readers import AUDIT, AUDIT_TIME


def audit_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(AUDIT).option("timestampFormat", AUDIT_TIME).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).json(path)


def denials(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes", time: str = "timestamp", role: str = "user_role") -> DataFrame:
    """(start, role, n_denied, n): counts by window and role; events later than the watermark are left out."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    counted = marked.groupBy(F.window(time, window).alias("__w"), role).agg(F.sum((F.col("status") == "DENIED").cast("long")).alias("n_denied"), F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("__w.start").alias("start"), role, "n_denied", "n")


def windowed_events(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(start, kind, n, total): the same over events of any kind."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    counted = marked.groupBy(F.window(time, window).alias("__w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("__w.start").alias("start"), kind, "n", "total")
