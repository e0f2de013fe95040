"""Calls that arrive as a stream: decomposition, deliveries counted once, and counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.sources import variants as sv


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of variant text files as they appear in a folder; ``sources.variants.decompose`` takes them on, as it keeps no state."""
    return sv.parse_lines(spark.readStream.text(folder), "value")


def delivered_once(calls: DataFrame, key: str = "call_id", at: str = "loaded_at", late: str = "7 days") -> DataFrame:
    """Each record once, however often it is delivered within ``late`` of its first delivery; state older than that is dropped."""
    return calls.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counts_per_window(calls: DataFrame, at: str = "loaded_at", width: str = "1 day", late: str | None = "7 days", by: str = "svtype") -> DataFrame:
    """Records per window of their delivery and type; a window is final once the watermark is past it.

    ``late`` is None where the stream has its watermark already, as after ``delivered_once``.
    """
    marked = calls.withWatermark(at, late) if late else calls
    return marked.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
