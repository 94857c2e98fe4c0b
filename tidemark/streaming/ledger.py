"""Streams: the run ledger as it grows, and its lines by day and status with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.incremental import canonical_path, status_word

LEDGER = "run_id string, source_path string, status string, total_seconds double, logged_at timestamp_ntz"


def ledger_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Lines of a folder of JSON ledgers, in one spelling of path and status."""
    raw = spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files_at_once).json(folder)
    return raw.select("run_id", canonical_path(F.col("source_path")).alias("source_path"), status_word(F.col("status")).alias("status"), "total_seconds", F.col("logged_at").cast("timestamp").alias("logged_at"))


def status_counts(lines: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Lines by window and status; those later than the watermark are no more counted, repeated ones count once."""
    once = lines.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["run_id", "source_path", "status"])
    return once.groupBy(F.window("logged_at", window).alias("w"), "status").agg(F.count("*").alias("lines")).select(F.col("w.start").alias("window_start"), "status", "lines")


def run_once(stream: DataFrame, table: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"):
    """Process what is there now and stop; a failed run goes on from its checkpoint."""
    return stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)
