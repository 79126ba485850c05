"""People's changes to events: rename, merge, move posts, soft deletion, audit rows; and titles that tell clusters apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.operators.order import high_middle, order_statistics
from hearsay.operators.vectors import similar_pairs


def merged_links(links: DataFrame, target: int, sources: Sequence[int]) -> DataFrame:
    """Links (event_id, post_id, rank) after events were merged into one: each post once per event, ranks from 1 on."""
    moved = links.withColumn("event_id", F.when(F.col("event_id").isin(*sources), F.lit(target)).otherwise(F.col("event_id")))
    once = moved.groupBy("event_id", "post_id").agg(F.min("rank").alias("rank"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy("rank", "post_id")))


def linked_totals(links: DataFrame, posts: DataFrame, key: str = "event_id") -> DataFrame:
    """(event_id, n, heat, first_at, last_at, middle_at) of events from their posts; the middle time is the upper one."""
    own = links.join(posts, "post_id")
    middle = order_statistics(own, [key], "at", {"middle_at": high_middle}).withColumnRenamed(key, "_key")
    total = own.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum("heat"), 2).alias("heat"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return total.join(middle, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def status_change(rows: DataFrame, key: str, chosen: Column, status: str, actor: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with a new status where chosen, and an audit row (key, before, after, actor, at) for each that changed."""
    changed = F.coalesce(chosen, F.lit(False)) & (F.col("status") != status)
    audit = rows.where(changed).select(key, F.col("status").alias("before"), F.lit(status).alias("after"), F.lit(actor).alias("actor"), at.alias("at"))
    return rows.withColumn("status", F.when(changed, status).otherwise(F.col("status"))), audit


def purge_plan(rows: DataFrame, ids: Sequence[int], dependents: dict[str, DataFrame], key: str) -> DataFrame:
    """(table, n): how many rows of each table a purge of those ids touches."""
    gone = rows.where(F.col(key).isin(*ids)).select(key)
    out = gone.agg(F.lit("rows").alias("table"), F.count("*").alias("n"))
    for name, df in dependents.items():
        out = out.union(df.join(gone, key, "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("n")))
    return out


def told_apart(events: DataFrame, title: str = "title", key: str = "event_id") -> DataFrame:
    """Events whose titles are made different: the first of a title keeps it, the others get an ordinal; keys get a short hash."""
    place = F.row_number().over(Window.partitionBy(title).orderBy(key))
    return events.withColumn("_p", place).withColumn("event_key", F.concat(F.lit("sem:"), F.substring(F.sha1(F.concat_ws("#", title, F.when(F.col("_p") > 1, F.col("_p")))), 1, 8))).withColumn(title, F.when(F.col("_p") > 1, F.concat(F.col(title), F.lit(" "), F.col("_p").cast("string"))).otherwise(F.col(title))).drop("_p")


def grey_pairs(centroids: DataFrame, low: float = 0.70, high: float = 0.86, n: int = 12) -> DataFrame:
    """(a, b, similarity) of the n most similar pairs of clusters (key, centroid of length one) that are neither surely one nor surely two."""
    pair = similar_pairs(centroids, None, low - 1e-9).withColumn("similarity", F.round("similarity", 9))
    return pair.where((F.col("similarity") >= low) & (F.col("similarity") < high)).orderBy(F.desc("similarity"), "a", "b").limit(n)
