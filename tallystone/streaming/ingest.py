"""Incremental ingestion with Structured Streaming: what is new since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_since(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, target: str, key: str, stamp: str, delay: str = "1 day"):
    """Append records of new files to ``target``, each key once within the watermark; returns the query.

    Runs over what is there and ends; a later run goes on from the checkpoint.
    """
    rows = spark.readStream.schema(schema).parquet(path).withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, stamp: str, width: str, by: str) -> DataFrame:
    """Counts by window and value, for batch and stream alike."""
    return events.groupBy(F.window(stamp, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), by, "n")
