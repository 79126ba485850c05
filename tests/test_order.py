"""Order statistics against plain sorting, with ranges forced on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hearsay.operators import order as od
from hearsay.operators import queue as qu
from hearsay.operators import relational as rel


@pytest.fixture
def rows():
    rng = random.Random(4)
    hot = [("hot", rng.choice([0.0, 0.0, 0.0, rng.random() * 100, float(rng.randrange(7))])) for _ in range(3000)]
    return hot + [(rng.choice("ab"), rng.random()) for _ in range(300)] + [("one", 5.0), (None, 1.0), (None, 1.0), ("a", None), ("nan", float("nan")), ("nan", 1.0)]


@pytest.mark.parametrize("share", [50, 10**9])
def test_running_counts(spark, rows, share):
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    bounds = od.value_bounds(df, "x", share=share)
    assert (len(bounds) > 20) == (share == 50)
    got = {(r.g, str(r.x)): (r.n, r.below, r.whole) for r in od.running_counts(df, ["g"], "x", bounds).collect()}
    at = lambda x: (0, 0) if x is None else (2, 0) if math.isnan(x) else (1, x)
    for g, x in rows:
        own = [at(v) for k, v in rows if k == g]
        assert got[g, str(x)] == (own.count(at(x)), sum(v < at(x) for v in own), len(own))


def test_midranks_of_a_hot_group(spark, rows, monkeypatch):
    monkeypatch.setattr(od, "SHARE", 50)
    known = [r for r in rows if r[1] is not None and not math.isnan(r[1])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(known)], "id long, g string, x double")
    got = {r.id: r.heat_rank for r in rel.midrank_percentile(df, "g", "x").collect()}
    assert len(got) == len(known)
    for i, (g, x) in enumerate(known):
        own = [v for k, v in known if k == g]
        assert math.isclose(got[i], round((sum(v < x for v in own) + own.count(x) / 2) * 100 / len(own), 2), abs_tol=0.0101)


def test_cases_of_mid_ranks(spark):
    """A lone row has 50; ties share the middle; the order of rows doesn't matter; values stay between 0 and 100."""
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 2.0), ("b", 9.0), ("c", 7.0), ("c", 7.0)], "g string, x double")
    got = sorted((r.g, r.x, r.heat_rank) for r in rel.midrank_percentile(df, "g", "x").collect())
    assert got == [("a", 1.0, 50.0), ("b", 1.0, 12.5), ("b", 2.0, 50.0), ("b", 2.0, 50.0), ("b", 9.0, 87.5), ("c", 7.0, 50.0), ("c", 7.0, 50.0)]
    assert rel.midrank_percentile(df.limit(0), "g", "x").count() == 0


def test_order_statistics(spark, rows, monkeypatch):
    monkeypatch.setattr(od, "SHARE", 50)
    df = spark.createDataFrame(rows, "g string, x double").where("x is null or not isnan(x)")
    got = {r.g: r for r in od.order_statistics(df, ["g"], "x", {"low": od.low_middle, "high": od.high_middle, "tenth": lambda n: F.lit(10)}, n=F.sum("n")).collect()}
    for g in ("hot", "a", "b", "one", None):
        own = sorted(x for k, x in rows if k == g and x is not None)
        assert (got[g].low, got[g].high, got[g].n) == (own[(len(own) - 1) // 2], own[len(own) // 2], len(own))
        assert got[g].tenth == (own[10] if len(own) > 10 else None)


def test_times_and_places(spark, monkeypatch):
    monkeypatch.setattr(od, "SHARE", 50)
    df = spark.range(500).selectExpr("id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, id % 90) t", "if(id = 3, null, id % 40) x")
    got = od.order_statistics(df.withColumn("g", F.lit(1)), ["g"], "t", {"low": od.low_middle}).collect()[0]
    assert 24 * (got.low.day - 1) + got.low.hour == 41  # of ids 0 to 499 by id % 90
    placed = od.global_places(df, -F.col("x"), [F.desc("x"), F.col("id")]).collect()
    want = sorted(((-(r.x) if r.x is not None else math.inf), r.id) for r in placed)
    assert {r.id: r.place for r in placed} == {i: k for k, (_, i) in enumerate(want, 1)}


def test_no_window_over_a_whole_group(spark, rows, monkeypatch):
    monkeypatch.setattr(od, "SHARE", 50)
    df = spark.createDataFrame(rows, "g string, x double")
    plan = od.running_counts(df, ["g"], "x")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range" in line or "_in" in line for line in windows)


@pytest.mark.parametrize("share", [50, 10**9])
def test_hot_values_are_spread(spark, monkeypatch, share):
    monkeypatch.setattr(od, "SHARE", share)
    df = spark.range(4000).selectExpr("if(id < 3000, 0, id) k", "id")
    found = df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    out = od.with_values(df, found, ["k"], 4000)
    assert out.count() == 4000 and out.where("k = 0").select("top").distinct().collect()[0][0] == 2999


def chosen_one_by_one(n, quota, chance, seed):
    rng, left, out = random.Random(seed), list(range(1, n + 1)), []
    if n <= quota:
        return left
    for _ in range(quota):
        out.append(left.pop(rng.randrange(1, len(left)) if len(left) > 1 and rng.random() < chance else 0))
    return sorted(out)


@pytest.mark.parametrize("n, quota", [(0, 5), (3, 5), (5, 5), (40, 0), (40, -1), (40, 12), (41, 40)])
@pytest.mark.parametrize("chance", [0.0, 0.3, 1.0])
def test_explored_places(n, quota, chance):
    for seed in range(20):
        assert qu.explored_places(n, quota, chance, seed) == (chosen_one_by_one(n, quota, chance, seed) if quota > 0 else [])


def test_explored(spark):
    items = spark.range(100).selectExpr("id", "id * 7 % 100 at")
    got = {r.place: r["at"] for r in qu.explored(items, -F.col("at"), [F.desc("at")], 10, 0.5, 3).collect()}
    assert sorted(got) == chosen_one_by_one(100, 10, 0.5, 3) and all(at == 100 - place for place, at in got.items())
