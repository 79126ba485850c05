"""Corpus preparation in five stages, each one Parquet table to the next.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all rows that
its predecessor kept. run(spark, sf_dir) applies them to `documents`. All stages but the last return
the columns of `documents`; the last returns the mixed text in blocks: shard, position, source,
doc_ids, words, text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm.decontaminate import decontaminate
from hearsay.llm.line_dedup import drop_repeated_lines
from hearsay.llm.lineage import shared_folder
from hearsay.llm.mixing import mix_sources
from hearsay.llm.near_dup import drop_near_duplicates
from hearsay.llm.queries import toxicity_model
from hearsay.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among them, doesn't reject."""
    return drop_toxic(docs, toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of repeated windows; n_chars follows the text."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each slot of an output shard, with its block of words and the documents that they are of."""
    return mix_sources(docs).blocks()


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: The classifier and the signatures are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
