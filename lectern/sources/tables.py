"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; only the columns used later are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
