"""Reading loose JSON, listing data files, and writing results in a chosen format."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPES = ("items", "data", "records", "posts", "notes")


def read_records(spark: SparkSession, path: str, schema: T.StructType, *, lines: bool = False) -> DataFrame:
    """Rows of JSON files: one object a line, or an array, an object, or an object whose first list under a usual name holds the rows.

    Files that don't parse give no rows.
    """
    if lines:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    own = T.ArrayType(schema)
    text = spark.read.option("wholetext", True).text(path)
    parsed = [F.from_json("value", own), *(F.from_json(F.get_json_object("value", f"$.{k}"), own) for k in ENVELOPES)]
    whole = F.from_json("value", schema)
    some = F.when(F.startswith(F.ltrim("value"), F.lit("{")), F.array(whole))
    rows = text.select(F.explode(F.coalesce(F.when(F.startswith(F.ltrim("value"), F.lit("[")), parsed[0]), *parsed[1:], some)).alias("r"))
    return rows.where("r is not null").select("r.*")


def aliased(df: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column for each name, the first of its aliases that is there and neither empty nor 0; where none is, the last one's value as it is."""

    def pick(name: str, names: Sequence[str]) -> Column:
        there = [F.nullif(F.nullif(F.col(n).cast("string"), F.lit("")), F.lit("0")) for n in names[:-1] if n in df.columns]
        there += [F.col(names[-1]).cast("string")] if names[-1] in df.columns else []
        return (F.coalesce(*there) if there else F.lit(None).cast("string")).alias(name)

    return df.select(*(pick(k, v) for k, v in columns.items()))


def list_files(spark: SparkSession, path: str, suffixes: Sequence[str] = ("json", "csv", "xlsx", "xls")) -> DataFrame:
    """(path, kind, bytes, modified) of data files below a folder, newest first; their contents are not read."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return own.where(F.col("kind").isin(*suffixes)).orderBy(F.desc("modified"), "path")


def file_stats(files: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """(kind, platform, files, bytes): totals by kind and by the platform named in the path."""
    platform = F.coalesce(*(F.when(F.contains("path", F.lit(f"/{p}")), F.lit(p)) for p in platforms), F.lit("other"))
    return files.groupBy("kind", platform.alias("platform")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "append") -> None:
    """Write as parquet, orc, json lines or CSV with a header; other kinds are refused."""
    if kind not in ("parquet", "orc", "json", "jsonl", "csv"):
        raise ValueError(f"no writer for {kind}")
    out = df.write.mode(mode)
    if kind == "csv":
        out = out.option("header", True)
    out.format("json" if kind == "jsonl" else kind).save(path)


def snapshot(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Every table as Parquet below one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
