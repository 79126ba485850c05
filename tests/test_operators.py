import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from hearsay.functions import score as sc
from hearsay.functions import text as tx
from hearsay.operators import cluster as cl
from hearsay.operators import merge as mg
from hearsay.operators import relational as rel
from hearsay.plans import assisted as ai


def test_midrank(spark):
    def ranks(values):
        df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
        return [r.heat_rank for r in rel.midrank_percentile(df, "g", "v").orderBy("v").collect()]

    assert ranks([10, 20, 20, 40]) == [12.5, 50, 50, 87.5]
    assert ranks([7]) == [50]
    assert ranks([]) == []


def test_growth_and_recency(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    row = spark.sql("select array(timestamp'2024-01-30', timestamp'2024-01-20', timestamp'2023-11-01', null) t").select(sc.growth(F.col("t"), now).alias("g"), sc.recency_weight(F.lit(None).cast("double")).alias("w"), sc.recency_weight(F.lit(21.0)).alias("h"), sc.recency_weight(F.lit(-3.0)).alias("f")).first()
    assert (row.g.recent, row.g.prior, row.g.growing) == (2, 1, True)
    assert (row.w, row.h, row.f) == (1.0, 0.5, 1.0)


def test_text_edges(spark):
    row = spark.createDataFrame([("https://A.example.com:443/x/?b=2&a=1&utm_source=q#f", "1.2万", None)], "u string, n string, z string").select(
        tx.canonical_url(F.col("u")).alias("u"), tx.parse_int(F.col("n")).alias("n"), tx.count_value(F.col("z")).alias("z"), tx.clean_text(F.col("z")).alias("c"), tx.canonical_url(F.lit("ftp://x/")).alias("bad"), tx.canonical_url(F.lit("https://u:p@x/")).alias("cred")
    ).first()
    assert tuple(row) == ("https://a.example.com/x?a=1&b=2", 12000, None, "", None, None)


def test_clusters_do_not_depend_on_order(spark):
    rng = random.Random(3)
    rows = [("b", i, float(i % 5), float(i % 200), [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    schema = "block string, id long, rank_key double, at_days double, vector array<double>"

    def run(data):
        return sorted(map(tuple, cl.greedy_clusters(spark.createDataFrame(data, schema), "block").collect()))

    first = run(rows)
    rng.shuffle(rows)
    assert run(rows) == first and len({c for _, _, c in first}) > 1


def test_merges_can_run_again(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    once = mg.insert_absent(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, mg.insert_absent(once, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, mg.upsert(old, new.distinct(), ["k"], ["v"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_aligned_takes_each_key_once(spark):
    new = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.9, 0.436])], "key string, centroid array<double>")
    old = spark.createDataFrame([("o", [1.0, 0.0])], "key string, centroid array<double>")
    assert [(r.key, r.old_key) for r in ai.aligned(new, old).collect()] == [("x", "o")]


def test_a_large_block_takes_memory_by_its_posts():
    # 3,000 clusters in one place that only their times keep apart: all pairs of them as objects took over a gigabyte
    vec, ids = np.tile([1.0, 0.0], (3000, 1)), np.arange(3000)
    own = cl._Clusters(2, 0.5)
    tracemalloc.start()
    cl._join(own, vec, ids * 1.0, ids * 1.0, 0.65)
    name = cl._merge(own, vec, ids, 0.86)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert own.live.sum() == 3000 and name.tolist() == ids.tolist() and peak < 20 << 20


def test_blocks_of_any_size_are_clustered(spark):
    rows = spark.range(20_500).selectExpr("1 as block", "id", "1.0D as rank_key", "double(id % 2 * 200) as at_days", "array(1.0D, 0.0D) as vector")
    assert sorted(tuple(r) for r in cl.greedy_clusters(rows, "block").groupBy("cluster").count().collect()) == [(0, 10_250), (1, 10_250)]
