"""The read side of events: platforms, orders, cards and details with fields worked out as of now, and texts for models."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions import score as sc
from hearsay.functions import text as tx
from hearsay.operators.relational import top_per_group

# Platforms in the order that they are shown in, names that tell them, labels of risk levels and their order.
DISPLAY_ORDER = ("xhs", "ks", "zhihu", "weibo", "tieba", "web", "campus")
PLATFORM_NAMES = {"weibo": ("weibo", "微博"), "xhs": ("xhs", "小红书"), "tieba": ("tieba", "贴吧"), "zhihu": ("zhihu", "知乎"), "ks": ("kuaishou", "快手")}
EXACT_NAMES = {"ks": "快手", "web": "网页", "campus": "投稿"}
RISK_LABELS = {"high": "高风险", "medium": "中风险", "low": "低风险"}
RISK_ORDER = {"high": 2, "medium": 1, "low": 0}


# --- platforms --------------------------------------------------------------------------------


def normal_platform(x: Column) -> Column:
    """The short code of a platform as stored in many ways; an unknown one in lower case, null as empty."""
    text = F.trim(F.coalesce(x, F.lit("")))
    low = F.lower(text)
    out = low
    # the first rule that holds decides, and weibo comes before web, which it begins with
    for code in ("campus", "web"):
        out = F.when((low == code) | F.contains(text, F.lit(EXACT_NAMES[code])), code).otherwise(out)
    for code in reversed(PLATFORM_NAMES):
        name, native = PLATFORM_NAMES[code]
        hit = F.contains(low, F.lit(name)) | F.contains(text, F.lit(native))
        out = F.when(hit | (low == code) if code in EXACT_NAMES else hit, code).otherwise(out)
    return out


def display_order(platforms: Column, order: Sequence[str] = DISPLAY_ORDER) -> Column:
    """Distinct platforms in the order of display; unknown ones last, by name, and none lost."""
    known = F.array(*map(F.lit, order))
    place = lambda p: F.struct(F.coalesce(F.nullif(F.array_position(known, p), F.lit(0)), F.lit(len(order) + 1)).alias("at"), p.alias("p"))
    return F.transform(F.array_sort(F.transform(F.array_distinct(platforms), place)), lambda s: s["p"])


def risk_label(level: Column) -> Column:
    out = level
    for k, v in RISK_LABELS.items():
        out = F.when(level == k, v).otherwise(out)
    return out


# --- orders -----------------------------------------------------------------------------------

#: Orders of lists by name: columns with their directions, the last one a tie-break.
ORDERS: dict[str, tuple[str, ...]] = {
    "events": ("-priority_score", "-ranking_score", "-heat_rank", "-heat_score", "event_key"),
    "notes": ("-ranking_score", "-heat_rank", "-heat_score", "note_id"),
    "clusters": ("-size", "signature"),
    "suggestions": ("-score", "event_rank", "keyword"),
    "hot posts": ("-heat_score", "-id"),
    "comments": ("-report_count", "-id"),
    "raw posts": ("-publish_time", "-id"),
    "by time": ("-event_time", "event_key"),
    "by risk": ("-risk_order", "-heat_score", "event_key"),
    "by heat": ("-heat_score", "event_key"),
}


def keys(order: str) -> list[Column]:
    """The sort keys of an order; a descending null comes last."""
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in ORDERS[order]]


def ordered(df: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """df in one of ORDERS, all of it or the first n; with a limit, tasks keep n rows each ahead of the shuffle."""
    own = df.withColumn("risk_order", sc.weight(F.col("risk_level"), RISK_ORDER, -1)) if order == "by risk" else df
    own = own.orderBy(*keys(order))
    return (own if n is None else own.limit(n)).select(*df.columns)


def recent(notes: DataFrame, n: int, at: Sequence[str] = ("first_crawled", "add_ts", "last_modify")) -> DataFrame:
    """The n latest notes by the first of several times that is known."""
    return notes.orderBy(F.coalesce(*map(F.col, at)).desc_nulls_last(), "id").limit(n)


def page_with_rank(df: DataFrame, order: str, page: int, size: int) -> DataFrame:
    """Rows of a page (from 1) with their place in the whole list, as place.

    Only the rows up to the page's end leave the tasks, sorted once for all of them.
    """
    top = df.orderBy(*keys(order)).limit(page * size)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*keys(order)))).where(F.col("place") > (page - 1) * size)


# --- read-time fields -------------------------------------------------------------------------


@dataclass(frozen=True)
class Recency:
    """Numbers of the read side."""

    half_life: float = sc.HALF_LIFE
    window: float = sc.WINDOW
    least_recent: int = sc.LEAST_RECENT

    @classmethod
    def of(cls, options: Mapping[str, str]) -> Recency:
        """From text options by name; one that is no positive finite number is left at its default."""
        own = {}
        for f in fields(cls):
            try:
                value = float(options.get(f.name, ""))
            except ValueError:
                continue
            if math.isfinite(value) and value > 0:
                own[f.name] = type(f.default)(value)
        return cls(**own)


def annotated(events: DataFrame, now: Column, config: Recency = Recency()) -> DataFrame:
    """events (event_time, member_times, risk_level, lifecycle, lifecycle_judgement) with age_days, recency_weight, growth, lifecycle and priority_score as of now.

    Events with very many posts come with growth as an aggregate (score.growth_of) instead of member_times.

    The judgement, or the stored lifecycle where there is none, escalates if posts still come.
    Nothing that was measured or judged, like risk and heat, is touched. An event that was never
    judged stays so and weighs 1.
    """
    own = events.withColumn("age_days", sc.age_days(F.col("event_time"), now)).withColumn("recency_weight", sc.recency_weight(F.col("age_days"), config.half_life))
    if "growth" not in events.columns:
        own = own.withColumn("growth", sc.growth(F.col("member_times"), now, config.window, config.least_recent))
    base = F.lower(F.trim(F.coalesce(F.nullif(F.col("lifecycle_judgement"), F.lit("")), F.col("lifecycle"), F.lit(""))))
    own = own.withColumn("lifecycle", sc.effective_lifecycle(base, F.col("growth.growing")))
    return own.withColumn("priority_score", sc.priority(F.lower(F.trim("risk_level")), F.col("recency_weight"), F.col("lifecycle")))


def read_events(stored: DataFrame, now: Column, config: Recency = Recency()) -> DataFrame:
    """Stored events as they are read: the time is event_time or, without one, last_seen_at; a missing risk level follows from heat."""
    own = stored.withColumn("event_time", F.coalesce("event_time", "last_seen_at")).withColumn("risk_level", sc.stored_risk(F.col("risk_level"), F.col("heat_score")))
    return annotated(own, now, config)


def links_by_event(links: DataFrame) -> DataFrame:
    """(event_id, post_ids, platforms): of each event's links (event_id, post_id, platform, rank), the distinct posts in order of rank, and platforms as shown."""
    post = links.groupBy("event_id", "post_id").agg(F.min("rank").alias("rank"))
    post = post.where("post_id is not null").groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "post_id"))), lambda s: s["post_id"]).alias("post_ids"))
    platform = links.select("event_id", normal_platform(F.col("platform")).alias("p")).where("p <> ''").groupBy("event_id").agg(display_order(F.collect_set("p")).alias("platforms"))
    empty = F.array().cast
    out = links.select("event_id").distinct().join(post, "event_id", "left").join(platform, "event_id", "left")
    return out.select("event_id", F.coalesce("post_ids", empty(post.schema["post_ids"].dataType)).alias("post_ids"), F.coalesce("platforms", empty("array<string>")).alias("platforms"))


def event_cards(events: DataFrame, links: DataFrame) -> DataFrame:
    """Cards of read events: EVT- id, label of the risk, posts and platforms, and the factors whose product is the priority."""
    own = events.join(links_by_event(links).withColumnRenamed("event_id", "id"), "id", "left")
    none = F.lit(0)
    breakdown = F.struct(sc.weight(F.col("risk_level"), sc.SEVERITY).alias("severity"), F.col("recency_weight").alias("recency"), sc.weight(F.col("lifecycle"), sc.LIFECYCLE).alias("lifecycle"))
    return own.select(
        F.concat(F.lit("EVT-"), F.col("id").cast("string")).alias("card_id"),
        F.col("id").alias("event_id"),
        "risk_level",
        risk_label(F.col("risk_level")).alias("risk_label"),
        F.coalesce("platforms", F.array().cast("array<string>")).alias("platforms"),
        F.coalesce("post_ids", F.array().cast("array<long>")).alias("post_ids"),
        F.coalesce(F.nullif("source_count", none), F.greatest(F.size("post_ids"), none)).alias("source_count"),
        "lifecycle",
        "priority_score",
        breakdown.alias("priority_breakdown"),
    )


def event_detail(events: DataFrame, event_id: int, published_only: bool = True) -> DataFrame:
    """The event of an id, if it may be seen: published, or any for those who review. No row stands for not found."""
    own = events.where(F.col("id") == event_id)
    return own.where("status = 'published'") if published_only else own


def representative_posts(links: DataFrame, processed: DataFrame, raw: DataFrame, n: int = 5) -> DataFrame:
    """The first n posts of each event by rank, with columns of the processed post, or of the raw one where there is none.

    links: event_id, rank, processed_id, raw_id. processed and raw: id, platform, title, likes.
    """
    first = top_per_group(links, "event_id", [F.col("rank"), F.col("raw_id")], n, rank="place").drop("place")
    side = lambda df, key, name: df.select(F.col("id").alias(key), F.struct("platform", "title", "likes").alias(name))
    own = first.join(side(processed, "processed_id", "p"), "processed_id", "left").join(side(raw, "raw_id", "r"), "raw_id", "left").withColumn("post", F.coalesce("p", "r"))
    return own.select("event_id", "rank", "processed_id", "raw_id", normal_platform(F.col("post.platform")).alias("platform"), F.col("post.title").alias("title"), F.coalesce("post.likes", F.lit(0)).alias("likes"))


def event_overview(events: DataFrame) -> DataFrame:
    """What a trend view takes of each event (with heat_before and risk_before of the last run, null if new): its trend, change of heat, and whether its risk rose."""
    rose = F.coalesce(sc.weight(F.col("risk_level"), RISK_ORDER) > sc.weight(F.col("risk_before"), RISK_ORDER), F.lit(False)) & F.col("risk_before").isNotNull()
    delta = F.round(F.col("heat_score") - F.coalesce("heat_before", F.lit(0.0)), 4)
    return events.select("event_key", "title", sc.memory_trend(F.col("heat_score"), F.col("heat_before")).alias("trend"), delta.alias("heat_delta"), "heat_score", "risk_level", F.coalesce("risk_before", F.lit("")).alias("previous_risk_level"), rose.alias("risk_escalated"), "source_count")


# --- texts for models -------------------------------------------------------------------------


def post_text(title: Column, content: Column, most: int = 256) -> Column:
    """Title and the beginning of the text on lines of their own, as they are embedded."""
    blank = F.lit("")
    return F.trim(F.concat(F.coalesce(title, blank), F.lit("\n"), F.substring(F.coalesce(content, blank), 1, most)), F.lit(" \n\t\r"))


def cut_text(x: Column, most: int = 20) -> Column:
    """A text as a title: what exceeds the limit gives way to an ellipsis."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…"))).otherwise(x)


def brief_text(title: Column, content: Column, most: int) -> Column:
    """The title, or else the text, trimmed and cut; empty if both are."""
    return F.substring(F.trim(F.coalesce(F.nullif(title, F.lit("")), content, F.lit(""))), 1, most)


def event_inputs(members: DataFrame, most: int = 20, chars: int = 120) -> DataFrame:
    """(event_key, texts): for each event the texts that a model judges it by.

    members: event_key, note_id, title, content, representative (its place among the shown posts,
    or null), place. Shown posts come first, then others by place, each post once. Limits per
    event cut each event's rows ahead of the shuffle.
    """
    own = members.select("event_key", "note_id", F.struct(F.col("representative").isNull(), "representative", "place", "note_id").alias("at"), brief_text(F.col("title"), F.col("content"), chars).alias("text"))
    once = own.groupBy("event_key", "note_id").agg(F.min("at").alias("at"), F.min_by("text", "at").alias("text")).where("text <> ''")
    first = top_per_group(once, "event_key", [F.col("at")], most)
    return first.groupBy("event_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("texts"))


def cluster_briefs(members: DataFrame, shown: int = 5, chars: int = 60) -> DataFrame:
    """(cluster, title, titles, first_day, last_day, size) of clusters of posts (cluster, note_id, title, content, publish_time, ranking_score)."""
    own = members.withColumn("text", brief_text(F.col("title"), F.col("content"), chars))
    best = top_per_group(own, "cluster", [F.desc("ranking_score"), F.col("note_id")], shown)
    titles = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("titles"))
    size = own.groupBy("cluster").agg(F.to_date(F.min("publish_time")).alias("first_day"), F.to_date(F.max("publish_time")).alias("last_day"), F.count("*").alias("size"))
    return size.join(titles, "cluster").select("cluster", F.get("titles", F.lit(0)).alias("title"), "titles", "first_day", "last_day", "size")


# --- answers ----------------------------------------------------------------------------------


def cited_events(answers: DataFrame, events: DataFrame) -> DataFrame:
    """(answer_id, cited, invented): event keys that an answer cites, in order, and cited ids that stand for nothing.

    answers: answer_id, text with [来源:...] marks. events: answer_id, cite_id, event_key, what the
    answer was given.
    """
    ids = answers.select("answer_id", F.posexplode(F.array_distinct(tx.citation_ids(F.col("text")))).alias("at", "cite_id"))
    met = ids.join(events.select("answer_id", "cite_id", "event_key"), ["answer_id", "cite_id"], "left")
    found = met.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_key", "cite_id"))).alias("c"))
    own = found.select("answer_id", F.transform(F.filter("c", lambda x: x["event_key"].isNotNull()), lambda x: x["event_key"]).alias("cited"), F.transform(F.filter("c", lambda x: x["event_key"].isNull()), lambda x: x["cite_id"]).alias("invented"))
    none = F.array().cast("array<string>")
    return answers.select("answer_id").join(own, "answer_id", "left").select("answer_id", F.coalesce("cited", none).alias("cited"), F.coalesce("invented", none).alias("invented"))


def best_overlap(members: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, event_key, shared): for each set of ids (target, note_id) the event (event_key, note_id) that shares most of them; the smaller key wins a tie."""
    both = targets.distinct().join(members.distinct(), "note_id").groupBy("target", "event_key").agg(F.count("*").alias("shared"))
    return both.groupBy("target").agg(F.min_by("event_key", F.struct(-F.col("shared"), F.col("event_key"))).alias("event_key"), F.max("shared").alias("shared"))


def truncation(rows: DataFrame, most: int) -> DataFrame:
    """(matched, analysed, dropped): what a limit on the analysed rows leaves out, for the run's log."""
    n = rows.agg(F.count("*").alias("matched"))
    return n.select("matched", F.least("matched", F.lit(most)).alias("analysed"), F.greatest(F.col("matched") - most, F.lit(0)).alias("dropped"))
