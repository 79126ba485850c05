"""State that outlives a run, as tables: pages of files, exports, documents by id, snapshots, cached answers, and what expires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException


def first_rows(df: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The first n rows of a file's table, NaN as null, and how many there are."""
    nan = {f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(nan).limit(n) if nan else df.limit(n), df.count()


def appended_array(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of a JSON array file after a write: those that were there and the new ones, one row a key, the stored one first."""
    own = stored.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in own.columns if c not in (key, "new")]
    return own.groupBy(key).agg(F.min_by(F.struct(*rest), "new").alias("r")).select(key, "r.*")


def crawl_export(items: DataFrame, source: str, at: Column) -> DataFrame:
    """(part, line): an export as JSON lines, one of meta with the number of items, then one an item; items stay spread over tasks."""
    meta = items.agg(F.count("*").alias("count")).select(F.lit("meta").alias("part"), F.to_json(F.struct(F.lit(source).alias("source"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "count")).alias("line"))
    return meta.unionByName(items.select(F.lit("item").alias("part"), F.to_json(F.struct(*items.columns)).alias("line")))


def save_or_update(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Documents by key after changes: fields that a change has (not null) replace those stored, others stay, unknown keys are added."""
    cols = [c for c in stored.columns if c != key]
    last = changes.groupBy(key).agg(*(F.last(c, ignorenulls=True).alias(f"new_{c}") for c in cols))
    return stored.join(last, key, "full").select(key, *(F.coalesce(f"new_{c}", c).alias(c) for c in cols))


def snapshot_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored snapshot, or None where there is none or it can't be read."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def cache_key(model: Column, messages: Column, temperature: Column) -> Column:
    """The key of a cached answer: a hash of all that decides it."""
    return F.sha2(F.to_json(F.struct(model.alias("model"), messages.alias("messages"), temperature.cast("double").alias("temperature"))), 256)


def answered_from_cache(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of asked rows (key): those with a cached answer (key, answer), and one row for each key that has to be asked."""
    known = cache.groupBy("key").agg(F.max("answer").alias("answer"))
    return asked.join(known, "key"), asked.join(known, "key", "left_anti").dropDuplicates(["key"])


def unexpired(rows: DataFrame, at: str, now: Column, seconds: float) -> DataFrame:
    """Rows written within the last `seconds`; what is older has expired, and a time that is not known has too."""
    return rows.where(F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp")) < int(seconds * 1_000_000))


def remembered(memory: DataFrame, now: Column, hours: float = 24.0) -> DataFrame:
    """Each user's latest memory (user_id, last_keyword, updated_at) that has not expired."""
    own = memory.where(F.coalesce("user_id", F.lit("")) != "").groupBy("user_id").agg(F.max_by("last_keyword", "updated_at").alias("last_keyword"), F.max("updated_at").alias("updated_at"))
    return unexpired(own, "updated_at", now, hours * 3600)
