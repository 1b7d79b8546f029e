"""Intermediate tables of iterations."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def step(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that the session names; where none is named, in one on this machine, for a local
    master only. Spark deletes it once nothing refers to it, where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='lodestone-')}")
    return df.checkpoint()
