"""Incremental ingestion: new files of a folder, each row once, late ones included up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """The rows of a folder's Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def once(rows: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """rows without those whose key was seen within the bound for late rows; at is the event time."""
    timed = rows.withColumn("event_time", F.col(at).cast("timestamp")).withWatermark("event_time", late)
    return timed.dropDuplicatesWithinWatermark([key]).drop("event_time")


def counts_by_window(rows: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n) by tumbling windows of the event time."""
    timed = rows.withColumn("event_time", F.col(at).cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def append_available(rows: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now to a Parquet folder and stops; a later call goes on from there."""
    return rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
