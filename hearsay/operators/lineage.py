"""Cutting the lineage of steps that repeat, in the folder that the session names."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines share; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "hearsay-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder and read from there, so that a later step doesn't repeat the ones before."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
