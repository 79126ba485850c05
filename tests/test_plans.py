from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.plans import evidence, events, ingest, planner
from hearsay.sources import files
from hearsay.streaming import posts as st


def test_ingest_to_ranked_events(spark):
    xhs = spark.createDataFrame([("1", "宿舍热水", "热水断供 投诉", 1767225600000, "1.2万", "3"), ("2", None, "食堂不错", 1767225600, "5", None), (None, "t", "c", None, None, None)], "note_id string, title string, desc string, time long, liked_count string, comment_count string")
    weibo = spark.createDataFrame([("9", "#热水# 停水了", "2026-01-02 03:04:05", "7")], "note_id string, content string, create_time string, liked_count string")
    raw = ingest.raw_posts(xhs, "xhs").unionByName(ingest.raw_posts(weibo, "weibo"))
    rows = {(r.platform, r.title): r for r in raw.collect()}
    assert rows["xhs", "宿舍热水"].likes == 12000 and rows["weibo", "#热水# 停水了"].tags == ["热水"]
    assert rows["xhs", "t"].external_id.startswith("generated:") and rows["xhs", "t"].publish_time is None
    done = ingest.processed_posts(raw)
    assert ingest.processed_posts(raw, done).count() == 0
    judged = ingest.judged_posts(ingest.ranked_posts(done))
    out = events.ranked_events(events.rule_events(judged), F.lit("2026-01-10").cast("timestamp")).collect()
    assert {r.event_key for r in out} == {"dorm_life", "canteen_life", "keyword:xhs"}
    assert [r.priority for r in out] == sorted((r.priority for r in out), reverse=True)
    top = next(r for r in out if r.event_key == "dorm_life")
    assert top.source_count == 2 and top.platforms == ["weibo", "xhs"] and top.top_tags[0].tag == "热水"
    assert events.event_cards(events.ranked_events(events.rule_events(judged), F.lit("2026-01-10").cast("timestamp"))).count() == 3


def test_suggestions(spark):
    ask = spark.createDataFrame([("hot water", 1.0, 0), ("water", 2.0, 9), ("exam", 1.0, 9)], "keyword string, age double, hits int")
    content = spark.createDataFrame([("exam", 99, 1.0)], "keyword string, engagement long, age double")
    told = spark.createDataFrame([(f"k{i}", "e", 0.9, True) for i in range(6)], "keyword string, event_key string, signal double, live boolean")
    crawls = spark.createDataFrame([("exam", 2.0, 5)], "keyword string, age double, stored long")
    rows = planner.suggestions(ask, content, told, crawls).collect()
    assert rows[0].keyword == "hot water" and sum(r.keyword.startswith("k") for r in rows) == 3 and "water" not in {r.keyword for r in rows}


def test_evidence(spark):
    policy = evidence.Policy(["Some University"], "SU", ["su.example.edu"], ["news.example.com"])
    hits = spark.createDataFrame([("https://su.example.edu/a/", "t", "our school", 1), ("https://SU.example.edu/a", "t", "twice", 2), ("https://news.example.com/x", "t", "SU says", 3), ("ftp://x", "t", "q", 4), ("https://b.example/", "t", " ", 5), ("https://c.example/", "Some University", "q", 6)], "url string, title string, quote string, seq long")
    got = {r.seq: r.scope for r in evidence.collect(hits, hits.limit(0).select(F.lit("").alias("url_hash")), policy).collect()}
    assert got == {1: "in_scope", 3: "needs_review", 6: "needs_review"}


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"id": 1, "name": "x"}, {"id": 2}]}')
    (tmp_path / "b.json").write_text('[{"id": 3}]')
    (tmp_path / "c.json").write_text('{"id": 4, "name": "z"}')
    (tmp_path / "d.json").write_text("{broken")
    schema = T.StructType().add("id", "long").add("name", "string")
    rows = files.read_records(spark, f"file://{tmp_path}", schema)
    assert sorted(r.id for r in rows.where("id is not null").collect()) == [1, 2, 3, 4]
    assert files.list_files(spark, f"file://{tmp_path}").count() == 4
    files.save(rows, f"file://{tmp_path}/out", "csv")
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).count() >= 4


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(2).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"file://{tmp_path}/in")

    def run(df, name, mode="append"):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    n = source.count()
    assert run(st.distinct_writes(stream, [], "event_id", late="60 days"), "d").count() == n
    assert run(st.windowed_counts(stream, "event_type"), "w", "complete").agg(F.sum("n")).first()[0] == n
    got = {r.event_id for r in run(st.cooled_down(stream, seconds=600.0), "c").collect()}
    last, want = {}, set()
    for r in source.orderBy("ts", "event_id").collect():
        at = r.ts.timestamp()
        if r.user_id not in last or at - last[r.user_id] >= 600:
            want.add(r.event_id)
            last[r.user_id] = at
    assert got == want
    writer = st.into_table(stream, lambda old, new: new if old is None else old.unionByName(new), f"file://{tmp_path}/t", f"file://{tmp_path}/ck")
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/t/v0").count() == n and schema
