"""Chains against a walk over each user's rows."""

import datetime as dt
import random

import pytest

from hearsay.operators import order as od
from hearsay.operators.chains import let_through


def walked(rows, seconds):
    last, out = {}, {}
    for u, t, o in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        ok = u not in last or (t - last[u]).total_seconds() >= seconds
        out[u, o] = ok
        last[u] = t if ok else last[u]
    return {(u, o): out.get((u, o), True) for u, _, o in rows}


@pytest.mark.parametrize("share", [10**9, 40])
def test_against_a_walk(spark, monkeypatch, share):
    monkeypatch.setattr(od, "SHARE", share)
    rng, start = random.Random(share), dt.datetime(2026, 1, 1)
    rows = [("bot", start + dt.timedelta(seconds=i), i) for i in range(700)]
    rows += [(rng.choice(["a", "b", None]), start + dt.timedelta(milliseconds=rng.choice([500, 1000, 2500]) * rng.randrange(4000)), 1000 + i) for i in range(900)]
    rows += [("tries", start + dt.timedelta(seconds=s), 3000 + s) for s in (0, 6, 12)] + [("same", start, 4000), ("same", start, 4001), ("late", None, 5000), ("late", start, 5001), ("late", None, 5002)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp, event_id long").repartition(3)
    got = {(r.user_id, r.event_id): r.allowed for r in let_through(df, seconds=10.0).collect()}
    assert got == walked(rows, 10.0)
    assert [got["tries", 3000 + s] for s in (0, 6, 12)] == [True, False, True]
    assert got["late", 5000] and got["late", 5002] and not got["same", 4001]


def test_edges(spark):
    empty = spark.createDataFrame([], "user_id string, ts timestamp, event_id long")
    assert let_through(empty).count() == 0
    one = spark.createDataFrame([("a", dt.datetime(2026, 1, 1), 1), ("a", dt.datetime(2026, 1, 1), 2)], empty.schema)
    assert let_through(one, seconds=0).where("allowed").count() == 2


def test_a_user_of_many_posts(spark):
    rows = spark.range(60_000).selectExpr("'bot' user_id", "timestamp_seconds(1767225600 + id) ts", "id event_id")
    out = let_through(rows, seconds=10.0)
    assert out.where("allowed").count() == 6_000 and out.where("allowed and event_id % 10 <> 0").count() == 0
