"""Keyed writes: upsert, soft and hard deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *newest: str) -> DataFrame:
    """One row per key: the last by the newest columns, null first; full copies count once."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("row"))
    return best.select(*keys, "row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key; columns are matched by name."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def deactivate(df: DataFrame, which: DataFrame, keys: list[str], flag: str = "is_active") -> DataFrame:
    """df with the flag down where the key is in which."""
    hit = which.select(*keys).distinct().withColumn("hit", F.lit(True))
    return df.join(hit, keys, "left").withColumn(flag, F.col(flag) & F.col("hit").isNull()).select(*df.columns)


def delete(df: DataFrame, which: DataFrame, keys: list[str]) -> DataFrame:
    """df without the rows whose key is in which."""
    return df.join(which.select(*keys).distinct(), keys, "left_anti")


def create_tables(spark: SparkSession, schemas: dict[str, str], folder: str) -> list[str]:
    """Parquet tables of the given schemas under folder where the catalog lacks them; the names of those it now has."""
    for name, schema in schemas.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet LOCATION '{folder}/{name}'")
    return sorted(n for n in schemas if spark.catalog.tableExists(n))


def replace_of(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of the keys in new deactivated, and the rows of new behind them."""
    return deactivate(old, new, [key]).unionByName(new, allowMissingColumns=True)
