"""Streams against a walk: memory that expires, and written rows with and without ids."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hearsay.streaming import memory as mm
from hearsay.streaming import posts as st

START = dt.datetime(2026, 1, 1)


def walked(rows, hours, history, trail):
    state, out = {}, {}
    for user, turn, at, topic, word, question in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[0], r[2], r[1])):
        keyword, asked, topics, last = state.get(user, ("", [], [], None))
        if last is not None and (at - last).total_seconds() > hours * 3600:
            keyword, asked, topics = "", [], []
        keyword = word or "" if topic == "switch" else "" if topic == "global" else keyword
        asked = ([*asked, question] if question else asked)[-history:]
        topics = ([t for t in topics if t != keyword] + [keyword] if keyword else topics)[-trail:]
        state[user] = keyword, asked, topics, at
        out[user, turn] = (keyword, asked[-1] if asked else None, len(asked), "|".join(topics))
    return out


def test_memory_over_batches_equals_a_walk(spark, tmp_path):
    rng = random.Random(2)
    rows, at = [], START
    for turn in range(400):
        at += dt.timedelta(minutes=rng.choice([1, 5, 90, 700]))
        rows.append((rng.choice(["a", "b", "c"]), turn, at, rng.choice(["switch", "continue", "global", None, "switch"]), rng.choice(["hot", "water", "exam", "", None]), rng.choice(["q", None]) and f"q{turn}"))
    rows += [(None, 900, at, "switch", "x", "q"), ("a", 901, None, "switch", "x", "q")]
    schema = "user_id string, turn_id long, ts timestamp, topic string, keyword string, question string"
    for k in range(4):  # files in order of time, one for each batch
        spark.createDataFrame(rows[100 * k : 100 * k + 100 + 2 * (k == 3)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    out = mm.run_to_table(mm.remembered(stream, hours=12.0, history=3, trail=2), f"file://{tmp_path}").collect()
    got = {(r.user_id, r.turn_id): (r.keyword, r.last_question, r.n_history, r.trail) for r in out}
    assert len(out) == 400 and got == walked(rows, 12.0, 3, 2)
    assert any(v[0] == "" for v in got.values()) and any("|" in v[3] for v in got.values())


def test_timers_drop_state(spark, tmp_path):
    schema = "user_id string, turn_id long, ts timestamp, topic string, keyword string, question string"
    for k, user in enumerate(["gone", "gone too", "here", "here"]):
        spark.createDataFrame([(user, k, START + dt.timedelta(days=3 * k), "switch", "hot", "q")], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    out = mm.run_to_table(mm.remembered(stream), f"file://{tmp_path}")
    assert out.count() == 4
    query = next(p for p in tmp_path.iterdir() if p.name.startswith("stream-"))
    left = spark.read.format("statestore").option("path", f"file://{query}/checkpoint").option("stateVarName", "memory").load()
    assert {r.key.user_id for r in left.collect()} == {"here"}


def test_rows_without_an_id_all_pass(spark, tmp_path):
    rows = [(None, "xhs", 1), (None, "xhs", 2), ("", "xhs", 3), ("a", "xhs", 4), ("a", "xhs", 5), ("a", "ks", 6), ("b", "xhs", 7), ("", "xhs", 8)]
    spark.createDataFrame([(*r, START) for r in rows], "id string, platform string, n long, ts timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id string, platform string, n long, ts timestamp").parquet(f"file://{tmp_path}/in")
    query = st.distinct_writes(stream, ["platform"], "id").writeStream.format("memory").queryName("written").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(r.n for r in spark.table("written").collect())
    assert [n for n in got if n not in (4, 5)] == [1, 2, 3, 6, 7, 8] and len(got) == 7


def test_write_ids(spark):
    rows = [("comments", "n1", "c1"), ("comments", "n1", ""), ("contents", "n1", "c1"), ("contents", None, "c1"), ("contents", "", None), (None, "n", None)]
    got = spark.createDataFrame(rows, "kind string, note string, comment string").select(st.write_id(F.col("kind"), F.col("note"), F.col("comment")).alias("id")).collect()
    assert [r.id for r in got] == ["c1", "n1", "n1", "c1", None, "n"]
