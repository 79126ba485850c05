"""Connected components by alternating star contractions, and a join that a hot key does not slow, entirely on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.lineage import cut

#: A key is hot above this share of all rows, so there are at most HOT hot keys to broadcast.
HOT = 1000
#: Edges for each partition that a round reads: a small graph takes few tasks, down to one of at most so many edges.
SHARE = 100_000


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left joined with right on a long column; right has one row for each key, and in n how many rows of left, out of at least total, have it.

    Rows with one of the at most HOT keys that hold over a share of 1 / HOT each get theirs from a
    broadcast of those few, and go on by the hash of the whole row; all others meet theirs by the key.
    """
    value = F.struct(*(c for c in right.columns if c not in (key, "n")))
    hot = F.broadcast(right.where(F.col("n") * HOT > total).select(key, value.alias("hot_value")))
    cold = right.where(F.col("n") * HOT <= total).select(F.col(key).alias("met_by"), value.alias("cold_value"))
    spread = left.join(hot, key, "left").withColumn("met_by", F.when(F.col("hot_value").isNull(), F.col(key)).otherwise(F.xxhash64(*left.columns)))
    found = spread.join(cold, "met_by", "left").withColumn("value", F.coalesce("hot_value", "cold_value")).where("value is not null")
    return found.select(*left.columns, "value.*")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Map each node of edges to the smallest node that it can reach: (node, component).

    Each round joins every node's neighbours to the smallest of them (large star, then small
    star) until no edge changes; rounds grow with the logarithm of the longest path. Nulls and
    loops carry no link. Isolated nodes have no row. The neighbours of a hot node are spread over
    tasks, and are never collected to one group.
    """
    link = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    before, total = None, 2 * link.count()
    while True:
        few = 1 + total // (2 * SHARE)
        both = link.union(link.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(few)
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, low, "u", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, "u", total)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(few).distinct()
        link = cut(small)
        now = link.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before, total = tuple(now), 2 * now[0]
    roots = link.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return link.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
