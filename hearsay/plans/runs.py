"""Runs that count what they write while they write it, and leave a row about themselves."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from hearsay.functions import text as tx

LOG = "run_id string, status string, total long, success long, failed long, detail string, error string"


def log_row(spark: SparkSession, run_id: str, counts: Mapping[str, int], error: str | None) -> DataFrame:
    """The log's row of a run: failed if it broke off or no row went well, partial if some didn't, else success."""
    total, failed = counts.get("total", 0), counts.get("failed", 0)
    status = "failed" if error is not None or failed and failed == total else "partial" if failed else "success"
    row = spark.createDataFrame([(run_id, status, total, total - failed, failed, json.dumps(dict(sorted(counts.items()))), error)], LOG)
    return row.withColumn("error", F.when(F.col("error").isNotNull(), tx.redacted(F.lit(None).cast("string"), F.col("error"))))


def observed_write(df: DataFrame, path: str, log: str, run_id: str, *, ok: Column | None = None, counts: Mapping[str, Column] | None = None) -> Row:
    """Write the rows of df that are ok to path, and append a row to the table at log; returns that row.

    `total`, `failed` (rows that aren't ok) and the other counts, aggregates by name, are
    observed as the rows pass by, so no second pass counts them. A write that raises is logged as
    failed with a redacted message, and raises on. The row is written in either case.
    """
    spark = df.sparkSession
    good = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    seen = Observation()
    watched = df.withColumn("_ok", good).observe(seen, F.count("*").alias("total"), F.count_if(~F.col("_ok")).alias("failed"), *(c.cast("long").alias(n) for n, c in (counts or {}).items()))
    found: dict[str, int] = {}
    error = None
    try:
        watched.where("_ok").drop("_ok").write.mode("overwrite").parquet(path)
        found = {k: int(v or 0) for k, v in seen.get.items()}
    except Exception as e:
        error = f"{type(e).__name__}: {e}"
        raise
    finally:
        row = log_row(spark, run_id, found, error)
        row.write.mode("append").parquet(log)
    return row.first()

