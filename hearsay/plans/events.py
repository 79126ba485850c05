"""Events from posts: grouping, aggregates, and the ranked read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions import score as sc
from hearsay.functions import text as tx
from hearsay.operators.relational import top_per_group

# Categories of events with their words.
EVENT_RULES: dict[str, Sequence[str]] = {
    "campus_safety": ("校园安全", "诈骗", "防诈骗", "短信", "缴费", "路灯", "夜间", "巡逻", "门禁", "陌生人", "尾随", "安全讲座"),
    "canteen_life": ("食堂", "饭堂", "价格", "卫生", "错峰", "窗口", "餐盘", "轻食", "套餐"),
    "course_schedule": ("课程安排", "课表", "考试", "选课", "补退选", "教务", "作业", "实验课", "问卷", "维护"),
    "dorm_life": ("宿舍", "热水", "后勤", "维修", "洗衣房", "停水"),
}


def rule_events(posts: DataFrame, *, rules: Mapping[str, Sequence[str]] = EVENT_RULES, least: int = 1, shown: int = 5) -> DataFrame:
    """One event for each category of judged posts with at least `least` of them.

    Sums and counts are aggregated ahead of the shuffle. Times of members are kept as counts by
    day, so an event with very many posts stays a short row.
    """
    own = posts.withColumn("event_key", sc.event_class(F.concat_ws(" ", "title", "content"), F.col("source_keyword"), rules))
    count = lambda label, c="sentiment": F.count_if(F.col(c) == label)
    event = own.groupBy("event_key").agg(
        F.count("*").alias("source_count"),
        F.round(F.sum("heat_score"), 2).alias("heat_score"),
        F.round(F.sum("heat_rank"), 2).alias("heat_rank"),
        F.round(F.sum("ranking_score"), 4).alias("ranking_score"),
        F.min("publish_time").alias("first_seen_at"),
        F.max("publish_time").alias("last_seen_at"),
        F.array_sort(F.collect_set("platform")).alias("platforms"),
        *(count(k).alias(f"_{k}") for k in ("negative", "controversial", "neutral", "positive")),
        F.max("risk_score").alias("_top"),
        count("high", "risk_level").alias("_high"),
        F.count_if(F.col("risk_level").isin("medium", "high")).alias("_raised"),
    ).where(F.col("source_count") >= least)
    risk = sc.event_risk(F.col("_top"), F.col("_high"), F.col("_raised"))
    event = event.withColumn("sentiment", sc.event_sentiment(*(F.col(f"_{k}") for k in ("negative", "controversial", "neutral", "positive")))).withColumn("risk_level", risk["level"]).withColumn("risk_score", risk["score"])
    event = event.withColumn("confidence", sc.confidence(F.col("source_count"))).drop("_negative", "_controversial", "_neutral", "_positive", "_top", "_high", "_raised")
    for name, what in (("concerns", "concerns"), ("risk_reasons", "reasons")):
        found = own.select("event_key", F.explode(what).alias("x")).groupBy("event_key").agg(F.array_sort(F.collect_set("x")).alias(name))
        event = event.join(found, "event_key", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    tags = own.select("event_key", F.explode(F.array_distinct(F.col("tags"))).alias("tag")).groupBy("event_key", "tag").agg(F.count("*").alias("count"))
    tags = top_per_group(tags, "event_key", [F.desc("count"), F.col("tag")], 10)
    tags = tags.groupBy("event_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag", "count"))), lambda t: F.struct(t["tag"].alias("tag"), t["count"].alias("count"))).alias("top_tags"))
    best = top_per_group(own, "event_key", [F.desc("ranking_score"), F.desc("heat_rank"), F.desc("heat_score"), F.col("note_id")], shown)
    best = best.groupBy("event_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "note_id", "title"))), lambda t: F.struct(t["note_id"].alias("note_id"), t["title"].alias("title"))).alias("representative_notes"))
    days = own.where("publish_time is not null").groupBy("event_key", F.to_date("publish_time").alias("day")).agg(F.count("*").alias("n"))
    days = days.groupBy("event_key").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("days"))
    return event.join(tags, "event_key", "left").join(best, "event_key", "left").join(days, "event_key", "left")


def growing(days: Column, now: Column, window: float = sc.WINDOW, least: int = sc.LEAST_RECENT) -> Column:
    """Whether an event grows, from its posts' counts by day (see score.growth)."""
    aged = F.filter(F.transform(days, lambda d: F.struct((sc.age_days(d["day"].cast("timestamp"), now)).alias("a"), d["n"].alias("n"))), lambda d: d["a"] >= 0)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, d: s + d["n"])
    recent = total(F.filter(aged, lambda d: d["a"] <= window))
    prior = total(aged) - recent
    span = F.greatest(F.coalesce(F.array_max(F.transform(aged, lambda d: d["a"])), F.lit(0.0)) - window, F.lit(window))
    return F.coalesce((recent >= least) & (recent / F.lit(window) >= prior / span), F.lit(False))


def ranked_events(events: DataFrame, now: Column, *, half_life: float = sc.HALF_LIFE) -> DataFrame:
    """Events with age, weight, growth, effective lifecycle and priority as of now, best first; stored columns stay as they are."""
    age = sc.age_days(F.col("last_seen_at"), now)
    life = F.col("lifecycle") if "lifecycle" in events.columns else F.lit("ongoing")
    own = events.withColumn("age_days", age).withColumn("recency_weight", sc.recency_weight(age, half_life)).withColumn("growing", growing(F.col("days"), now))
    own = own.withColumn("effective_lifecycle", sc.effective_lifecycle(life, F.col("growing")))
    own = own.withColumn("priority", sc.priority(F.col("risk_level"), F.col("recency_weight"), F.col("effective_lifecycle")))
    return own.orderBy(F.desc("priority"), F.desc("ranking_score"), F.desc("heat_rank"), F.desc("heat_score"), "event_key")


def event_cards(events: DataFrame, n: int = 8) -> DataFrame:
    """Numbered cards of the first events, texts cut to what a prompt takes."""
    return events.limit(n).select(F.concat(F.lit("e"), F.row_number().over(_first()).cast("string")).alias("cite_id"), "event_key", "risk_level", "sentiment", "source_count", F.slice("representative_notes", 1, 5).alias("notes"), tx.clean_text(F.array_join("concerns", " ")).alias("concerns"))


def _first():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("priority"), F.desc("ranking_score"), "event_key")
