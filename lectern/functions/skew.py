"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of a heavy key are split; a key is heavy above so many rows and this share of all, so at most 1 / SHARE keys are.
SALTS, HEAVY, SHARE = 16, 10_000, 1e-4


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], by: str, how: str = "inner", salts: int = SALTS, heavy: int = HEAVY) -> DataFrame:
    """many joined with one on keys; the rows of a heavy key of many are split by a hash of the column by, and those of one are repeated for each part.

    many is counted first, so it should be a scan or cut (see lineage); one should hold
    few rows of each key. Null keys match nothing; how is inner or left.
    """
    n = many.count()
    if n <= heavy:  # no key can be heavy
        return many.join(one, keys, how)
    hot = many.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > max(heavy, int(SHARE * n))).select(*keys, F.lit(salts).alias("salts"))
    parted = many.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    repeated = one.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return parted.join(repeated, [*keys, "salt"], how).drop("salt")
