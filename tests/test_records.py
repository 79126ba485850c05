"""Checks of comments on tables where most go to one event."""

from pyspark.sql import functions as F

from hearsay.operators import order as od
from hearsay.plans import records as rc


def test_comments_on_one_event_are_spread(spark, monkeypatch):
    monkeypatch.setattr(od, "SHARE", 100)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        i = F.col("id")
        new = spark.range(4000).select(i, F.when(i < 8, i).otherwise(1).alias("event_id"), i.alias("user_id"), F.lit("").alias("username"), F.lit("不错").alias("content"), F.when(i % 100 == 0, 11).cast("long").alias("parent_id"))
        events = spark.createDataFrame([(1, "published"), (2, "draft")], "id long, status string")
        known = spark.createDataFrame([(11, 1, None)], "id long, event_id long, parent_id long")
        rows = rc.checked_comments(new, events, known).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(rows) == 4000
    assert {r.id: r.error for r in rows if r.error} == {0: "no such event", 2: "not published"} | {k: "no such event" for k in range(3, 8)}
    assert max(sum(r.task == t for r in rows) for t in {r.task for r in rows}) < 2000
