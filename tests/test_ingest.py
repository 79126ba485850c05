"""Field rules of native rows, counts and tags."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hearsay.functions import text as tx
from hearsay.plans import ingest
from hearsay.sources import files


def column(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_topics(spark):
    long_topic = "很" * 21
    got = column(spark, tx.topics, ["今天去了#中山大学食堂#，还聊到#宿舍空调#的问题", "#中山大学[超话]#今日打卡", "#食堂#好吃 #食堂#真好吃 #涨价#", "普通微博没有话题", "", None, f"#水# #{long_topic}#", "#跨\n行#", "# 空格[超话] #"])
    assert got == [["中山大学食堂", "宿舍空调"], ["中山大学"], ["食堂", "涨价"], [], [], [], [], [], ["空格"]]


def test_tag_names(spark):
    got = column(spark, tx.tag_names, ['[{"name":"宿舍","type":"topic"},{"name":"空调"}]', '["期末周", "食堂"]', "not-json", "", None, "null", '"中山大学,中大破冰, "', '{"name":"x"}', "5", '[{"name":" a "},{"name":""},{},"a"]'])
    assert got == [["宿舍", "空调"], ["期末周", "食堂"], [], [], [], [], ["中山大学", "中大破冰"], [], [], ["a"]]


def test_counts(spark):
    assert column(spark, tx.int_count, ["1.2万", "3k+", "2K", "1,234", "-5", " 7 万", "None", "", None, "赞 9"]) == [12000, 3, 2000, 1234, 0, 70000, 0, 0, 0, 9]
    assert column(spark, tx.count_value, ["点赞 1.2万", "1，000+", "12++", "-1.5万", "3千", "2百", "1亿", "-2.5", "9赞", "+", "", None, "阅读", "1.2.3"]) == [12000, 1000, 12, -15000, 3000, 200, 100000000, -2, None, None, None, None, None, None]


def test_clean_text_knows_python_white_space(spark):
    white = "\x1c\x1d\x1e\x1f\x85\xa0 ​　 \t"
    assert column(spark, tx.clean_text, [f"{white}a{white}b{white}"]) == ["a b"]
    assert column(spark, tx.stripped, [f"{white}a b{white}", None]) == ["a b", ""]


MS = 1781222400000  # 2026-06-12


@pytest.mark.parametrize("created, want", [(MS, MS), (None, MS + 1000), (0, MS + 1000)])
def test_ks(spark, created, want):
    row = spark.createDataFrame([("3xabc", "t", "d", " https://x/3xabc ", created, MS + 1000, "1234", "56")], "video_id string, title string, desc string, video_url string, create_time long, add_ts long, liked_count string, comment_count string")
    got = ingest.raw_posts(row, "ks").collect()[0]
    assert (got.external_id, got.likes, got.comments, got.collects, got.shares, got.tags, got.url) == ("3xabc", 1234, 56, 0, 0, [], "https://x/3xabc")
    assert got.publish_time == dt.datetime.fromtimestamp(want / 1000, dt.UTC).replace(tzinfo=None)


def test_zhihu_times(spark):
    rows = [("1", str(MS // 1000)), ("2", "0"), ("3", ""), ("4", None), ("5", "昨天"), ("6", "-3")]
    native = spark.createDataFrame([(i, t, MS + 5000) for i, t in rows], "content_id string, created_time string, add_ts long")
    got = {r.external_id: r.publish_time.second for r in ingest.raw_posts(native, "zhihu").collect()}
    assert got == {"1": 0, **{str(i): 5 for i in range(2, 7)}}


def test_xhs_and_tieba(spark):
    xhs = spark.createDataFrame([("1", None, MS, json.dumps([{"name": "食堂"}, {"name": "食堂"}])), ("2", MS + 9000, MS, "broken")], "note_id string, publish_timestamp_ms long, time long, tag_list string")
    got = {r.external_id: r for r in ingest.raw_posts(xhs, "xhs").collect()}
    assert got["1"].tags == ["食堂"] and got["2"].tags == [] and (got["2"].publish_time - got["1"].publish_time).seconds == 9
    assert got["1"].title == "1" and got["1"].source_keyword == "xhs"
    tieba = spark.createDataFrame([("1", " 中山大学 ", "2026/06/12 10:11"), ("2", None, "?")], "note_id string, tieba_name string, publish_time string")
    got = {r.external_id: r for r in ingest.raw_posts(tieba, "tieba").collect()}
    assert got["1"].tags == ["中山大学"] and got["2"].tags == [] and got["1"].publish_time == dt.datetime(2026, 6, 12, 10, 11) and got["2"].publish_time is None


def test_weibo_time(spark):
    rows = spark.createDataFrame([("1", 0, "2026-06-12 08:00:00"), ("2", MS // 1000, "2026-06-13 08:00:00"), ("3", None, None)], "note_id string, create_time long, create_date_time string")
    got = {r.external_id: r.publish_time for r in ingest.raw_posts(rows, "weibo").collect()}
    assert got == {"1": dt.datetime(2026, 6, 12, 8), "2": dt.datetime(2026, 6, 12), "3": None}


def test_aliases_end_with_the_last_as_it_is(spark):
    rows = spark.createDataFrame([("", None, 0), ("", "n", 5), (None, "0", 7)], "a string, b string, c long")
    assert [r.id for r in files.aliased(rows, {"id": ("a", "b", "c")}).collect()] == ["0", "n", "7"]
