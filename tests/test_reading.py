"""The read side, records, model-assisted plans and stored state on small edges that the queries don't reach."""

import pytest
from pyspark.sql import functions as F

from hearsay.operators import cluster as cl
from hearsay.operators.chains import let_through
from hearsay.plans import assisted as ai
from hearsay.plans import evidence as ev
from hearsay.plans import reading as rd
from hearsay.plans import records as rc
from hearsay.sources import state as st


def test_cooldown_counts_from_the_last_that_was_let_through(spark):
    rows = spark.sql("select * from values (1, 1, timestamp '2024-01-01 00:00:00'), (1, 2, timestamp '2024-01-01 00:00:06'), (1, 3, timestamp '2024-01-01 00:00:12'), (2, 4, timestamp '2024-01-01 00:00:01') t(user_id, event_id, ts)")
    assert {r.event_id: r.allowed for r in let_through(rows).collect()} == {1: True, 2: False, 3: True, 4: True}
    assert let_through(rows.limit(0)).count() == 0


def test_recency_options_and_unjudged_events(spark):
    assert rd.Recency.of({"half_life": "7", "window": "nan", "least_recent": "x"}) == rd.Recency(half_life=7.0)
    rows = spark.sql("select 'a' k, timestamp '2024-01-31' event_time, array(timestamp '2024-01-30', timestamp '2024-01-31') member_times, 'high' risk_level, '' lifecycle, '' lifecycle_judgement union all select 'b', null, null, null, 'Escalating', null")
    got = {r.k: r for r in rd.annotated(rows, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got["a"].lifecycle == "" and got["a"].growth.growing and got["a"].priority_score == pytest.approx(9 * 0.5 ** (1 / 21))
    assert got["b"].lifecycle == "ongoing" and got["b"].recency_weight == 1.0 and got["b"].priority_score == 2.0


def test_alignment_is_greedy_and_one_to_one(spark):
    new = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "key long, centroid array<double>")
    old = spark.createDataFrame([(10, [0.9, 0.4358899]), (11, [0.6, 0.8])], "key long, centroid array<double>")
    pairs = sorted(((sum(a * b for a, b in zip(x.centroid, y.centroid)), x.key, y.key) for x in new.collect() for y in old.collect()), reverse=True)
    want, used = {}, set()
    for s, a, b in pairs:
        if s >= 0.7 and a not in want and b not in used:
            want[a] = b
            used.add(b)
    assert {r.key: r.old_key for r in ai.aligned(new, old, 0.7).collect()} == want
    assert ai.aligned(new, old.limit(0)).count() == 0


def test_semantic_events_keep_the_key_of_the_last_run(spark):
    rows = [(0, i, float(i), 1.0, [1.0, 0.01 * i], f"head {i}", "word" if i else "") for i in range(3)] + [(0, 10 + i, 1.0, 1.0, [0.01 * i, 1.0], "other", "") for i in range(2)] + [(0, 20, 1.0, 1.0, [-1.0, 0.0], "alone", "")]
    posts = spark.createDataFrame(rows, "block int, id long, rank_key double, at_days double, vector array<double>, title string, keyword string")
    old = spark.createDataFrame([("kept", "old title", [1.0, 0.0])], "key string, title string, centroid array<double>")
    got = {tuple(r.note_ids): r for r in ai.semantic_events(posts, previous=old).collect()}
    assert set(got) == {(0, 1, 2), (10, 11)} and got[0, 1, 2].event_key == "kept" and got[0, 1, 2].title == "old title"
    assert got[10, 11].event_key.startswith("sem:") and got[10, 11].title == "other"
    fresh = {tuple(r.note_ids): r.title for r in ai.semantic_events(posts).collect()}
    assert fresh[0, 1, 2] == "word"


def test_merge_by_verdict_passes_over_what_is_gone(spark):
    pairs = spark.createDataFrame([(1, 2, 0.85, True), (2, 3, 0.8, True), (1, 4, 0.75, False), (3, 5, 0.72, True)], "a long, b long, similarity double, same boolean")
    assert {r.gone: r.into for r in ai.merged_by_verdict(pairs).collect()} == {2: 1, 5: 3}


def test_reviews_decide_once_and_need_a_reason(spark):
    subs = spark.sql("select id, status, 't' title, 'c' content, 'u' username, timestamp '2024-01-01' created_at from values (1, 'pending'), (2, 'pending'), (3, 'pending'), (4, 'approved') t(id, status)")
    told = spark.createDataFrame([(1, True, None), (2, False, "off topic"), (3, False, " "), (4, False, "late")], "id int, approve boolean, comment string")
    after, raw = rc.reviewed(subs, told)
    assert {r.id: r.status for r in after.collect()} == {1: "approved", 2: "rejected", 3: "pending", 4: "approved"}
    assert [r.external_id for r in raw.collect()] == ["sub:1"]


def test_blank_queries_fail(spark):
    with pytest.raises(Exception, match="blank"):
        ev.query_specs(spark.createDataFrame([("a",), (" ",)], "query string"), ["p"]).collect()


def test_state(spark, tmp_path):
    assert st.snapshot_or_none(spark, f"file://{tmp_path}/none") is None
    spark.range(3).write.parquet(f"file://{tmp_path}/some")
    assert st.snapshot_or_none(spark, f"file://{tmp_path}/some").count() == 3
    rows, n = st.first_rows(spark.createDataFrame([(1, float("nan")), (2, 1.0)], "id long, v double"), 1)
    assert n == 2 and rows.count() == 1
    assert st.first_rows(spark.createDataFrame([(1, float("nan"))], "id long, v double"), 1)[0].first().v is None
    memory = spark.sql("select * from values ('a', 'x', timestamp '2024-01-01'), ('a', 'y', timestamp '2024-01-02'), ('', 'z', timestamp '2024-01-02'), ('b', 'w', null) t(user_id, last_keyword, updated_at)")
    assert [tuple(r)[:2] for r in st.remembered(memory, F.lit("2024-01-02 10:00:00").cast("timestamp")).collect()] == [("a", "y")]


def test_orders_and_briefs_of_nothing(spark):
    empty = spark.createDataFrame([], "event_key string, priority_score double, ranking_score double, heat_rank double, heat_score double")
    assert rd.ordered(empty, "events", 3).count() == 0 and rd.page_with_rank(empty, "events", 1, 5).count() == 0
    assert cl.top_by_cosine(spark.createDataFrame([], "vec_id long, embedding array<double>"), [1.0]).count() == 0
