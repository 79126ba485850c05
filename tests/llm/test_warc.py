"""Revisits with wrong dates, bursts and repeated rows, against a plain as-of search."""

import random

import pytest

from hearsay.llm import warc

SCHEMA = "record_id long, url string, ts long, type string, status int, headers map<string,string>, payload string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, t, k, 200 if k == "response" else 304, {"etag": "1"}, f"p{i}" if k == "response" else None) for i, u, t, k in rows], SCHEMA)


def searched(rows):
    out = {}
    for i, u, t, k in rows:
        if k == "revisit":
            before = [(s, j) for j, v, s, kind in rows if kind == "response" and v == u and (s, j) < (t, i)]
            out[i] = max(before)[1] if before else None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_outliers_and_bursts(spark, monkeypatch, seed):
    monkeypatch.setattr(warc, "PARTS", 16)
    rng = random.Random(seed)
    kind = lambda: rng.choice(["response", "revisit", "revisit"])
    rows = [(i, f"http://a/{rng.randrange(3)}", 1_700_000_000 + rng.randrange(200), kind()) for i in range(400)]
    rows += [(1000 + i, "http://a/0", 1_700_000_100, kind()) for i in range(300)]  # a burst at one moment
    rows += [(5000, "http://a/1", 0, "response"), (5001, "http://a/1", 253_402_300_799, "revisit"), (5002, "http://a/2", 253_402_300_799, "response")]
    rng.shuffle(rows)
    got = {r.record_id: r.response_id for r in warc.latest_response(table(spark, rows).selectExpr("record_id", "url url_key", "ts", "type = 'response' full")).collect()}
    assert got == searched(rows)


def test_a_wrong_date_leaves_the_stretches_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(warc, "PARTS", 16)
    rows = [(i, "http://a/", 1_700_000_000 + i, "revisit") for i in range(800)] + [(900, "http://a/", 0, "revisit"), (901, "http://a/", 10**12, "revisit")]
    own = table(spark, rows)
    sizes = [r["count"] for r in own.groupBy(warc._stretch(own).alias("part")).count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 150
    burst = table(spark, [(i, "http://a/", 5, "revisit") for i in range(800)])
    sizes = [r["count"] for r in burst.groupBy(warc._stretch(burst).alias("part")).count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 150


@pytest.mark.parametrize("revisits, responses", [(3, 1), (4, 2), (1, 5)])
def test_repeated_rows_do_not_multiply(spark, revisits, responses):
    rows = [(1, "http://a/", 1, "response")] * responses + [(2, "http://a/", 2, "revisit")] * revisits
    out = warc.resolve_revisits(table(spark, rows)).collect()
    assert len(out) == revisits and {(r.record_id, r.response_id, r.payload) for r in out} == {(2, 1, "p1")}
