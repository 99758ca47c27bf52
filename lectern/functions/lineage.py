"""Cutting long lineages with files that survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there.

    The folder is the session's spark.checkpoint.dir, or what was set on its context; all
    executors must share it. Only a session on one machine (master local) may leave it
    unset and gets a folder of its own; on a cluster that is an error. With
    spark.cleaner.referenceTracking.cleanCheckpoints=true the files go when df does.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores; only one that is read in fewer is shuffled."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
