"""From native rows of several platforms to posts with heat, rank and risk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions import score as sc
from hearsay.functions import text as tx
from hearsay.operators.relational import midrank_percentile

# Native columns of each platform, by the column of a raw post that they fill; of several, the first that holds something.
NATIVE: dict[str, dict[str, str | tuple[str, ...]]] = {
    "xhs": {"external_id": "note_id", "title": "title", "content": "desc", "url": "note_url", "published": ("publish_timestamp_ms", "time"), "author": "nickname", "likes": "liked_count", "collects": "collected_count", "comments": "comment_count", "shares": "share_count", "keyword": "source_keyword", "tags": "tag_list"},
    "weibo": {"external_id": "note_id", "content": "content", "url": "note_url", "published": ("create_time", "create_date_time"), "author": "nickname", "likes": "liked_count", "comments": "comments_count", "shares": "shared_count", "keyword": "source_keyword", "tags": "content"},
    "tieba": {"external_id": "note_id", "title": "title", "content": "desc", "url": "note_url", "published": "publish_time", "author": "user_nickname", "comments": "total_replay_num", "keyword": "source_keyword", "tags": "tieba_name"},
    "zhihu": {"external_id": "content_id", "title": "title", "content": "content_text", "url": "content_url", "published": ("created_time", "add_ts"), "author": "user_nickname", "likes": "voteup_count", "comments": "comment_count", "keyword": "source_keyword"},
    "ks": {"external_id": "video_id", "title": "title", "content": "desc", "url": "video_url", "published": ("create_time", "add_ts"), "author": "nickname", "likes": "liked_count", "comments": "comment_count", "keyword": "source_keyword"},
}
COUNTS = ("likes", "collects", "comments", "shares")
#: How a platform's tags are read: names of a list, topics within the text, or one forum's name.
_TAGS: dict[str, Callable[[Column], Column]] = {
    "xhs": tx.tag_names,
    "weibo": tx.topics,
    "tieba": lambda x: F.when(tx.stripped(x) != "", F.array(tx.stripped(x))).otherwise(F.array().cast("array<string>")),
}


def published_at(x: Column) -> Column:
    """A time from epoch seconds or milliseconds, or from text in a usual form; null if neither."""
    n, s = x.cast("string").try_cast("long"), F.replace(x.cast("string"), F.lit("/"), F.lit("-"))
    stamp = F.when(n > 10_000_000_000, F.timestamp_millis(n)).when(n > 0, F.timestamp_seconds(n))
    return F.coalesce(stamp, F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(s, F.lit("yyyyMMdd")))


def _first_time(native: DataFrame, platform: str) -> Column:
    """The first native time that holds something: neither empty nor, as a number, 0; a zhihu text has to be a number over 0."""
    names = NATIVE[platform]["published"]
    found = []
    for c in (names,) if isinstance(names, str) else names:
        if c not in native.columns:
            continue
        x = tx.stripped(F.col(c))
        good = x != ""
        if native.schema[c].dataType.typeName() != "string":
            good = good & (F.col(c).try_cast("double") != 0)
        elif platform == "zhihu" and c == "created_time":
            good = good & (F.coalesce(x.try_cast("long"), F.lit(0)) > 0)
        found.append(F.when(good, x))
    return published_at(F.coalesce(*found) if found else F.lit(None).cast("string"))


def raw_posts(native: DataFrame, platform: str) -> DataFrame:
    """Native rows as raw posts.

    Counters that a platform lacks are 0, a missing title is the text's beginning, a missing id a
    hash. A time that is missing or 0 gives way to the next one, with zhihu and ks in the end to
    when the row was added. Tags are the names of xhs's list, weibo's topics and tieba's forum.
    """
    names = NATIVE[platform]
    get = lambda c: F.col(names[c]).cast("string") if names.get(c) in native.columns else F.lit(None).cast("string")
    ident = F.coalesce(F.nullif(tx.stripped(get("external_id")), F.lit("")), tx.fallback_id(F.lit(platform), get("url"), get("title"), get("content")))
    content = tx.stripped(get("content"))
    title = tx.first_text(tx.stripped(get("title")), F.substring(content, 1, 80), ident)
    return native.select(
        F.lit(platform).alias("platform"),
        F.substring(ident, 1, 255).alias("external_id"),
        F.substring(title, 1, 500).alias("title"),
        content.alias("content"),
        F.substring(tx.stripped(get("url")), 1, 500).alias("url"),
        F.substring(tx.stripped(get("author")), 1, 100).alias("author"),
        _first_time(native, platform).alias("publish_time"),
        *(tx.int_count(get(c)).alias(c) for c in COUNTS),
        F.substring(tx.first_text(tx.stripped(get("keyword")), F.lit(platform)), 1, 255).alias("source_keyword"),
        (_TAGS[platform](get("tags")) if platform in _TAGS else F.array().cast("array<string>")).alias("tags"),
        F.lit("normal").alias("status"),
    )


def processed_posts(raw: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Cleaned posts with heat from raw ones that may be used and are not among the processed ones."""
    own = raw.where(F.coalesce("status", F.lit("")).isin("normal", "active", ""))
    if processed is not None:
        own = own.join(processed.select("platform", "external_id"), ["platform", "external_id"], "left_anti")
    title, content = tx.clean_text(F.col("title")), tx.clean_text(F.col("content"))
    return own.select(
        F.concat_ws(":", "platform", "external_id").alias("note_id"),
        "platform",
        "external_id",
        tx.first_text(title, F.substring(content, 1, 30)).alias("title"),
        tx.first_text(content, title).alias("content"),
        "publish_time",
        F.to_date("publish_time").alias("publish_date"),
        *COUNTS,
        sc.heat_score(*map(F.col, COUNTS)).alias("heat_score"),
        "source_keyword",
        "tags",
        F.lit(False).alias("excluded"),
    )


def ranked_posts(processed: DataFrame) -> DataFrame:
    """All posts that are not excluded, with their heat rank within the platform and the score that posts are sorted by."""
    own = midrank_percentile(processed.where("not excluded"), "platform", "heat_score")
    return own.withColumn("ranking_score", sc.ranking_score(F.col("platform"), F.col("heat_rank")))


def judged_posts(ranked: DataFrame) -> DataFrame:
    """Ranked posts with sentiment, risk and concerns by rules."""
    text = tx.clean_text(F.concat_ws(" ", "title", "content", F.array_join("tags", " "), "source_keyword"))
    own = ranked.withColumn("_r", sc.note_risk(text, F.lit("neutral"), F.lit("low"), F.col("comments"), F.col("shares"), F.col("heat_rank"), F.col("heat_score")))
    return own.select(*ranked.columns, "_r.*", sc.concerns(text).alias("concerns"))


def agent_rows(processed: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Processed posts (id, note_id, title, content, tags_json, heat_score and counts) as rows for analysis: tags as distinct words, and the post's comments.

    comments: note_id, texts (the best of them, in order). Posts without any have an empty list.
    """
    words = F.transform(F.coalesce(F.from_json("tags_json", "array<string>"), F.array().cast("array<string>")), lambda t: F.trim(t))
    own = processed.withColumn("keywords", F.array_distinct(F.filter(words, lambda t: t != ""))).drop("tags_json")
    none = F.array().cast("array<string>")
    if comments is None:
        return own.withColumn("top_comments", none)
    return own.join(comments.select("note_id", F.col("texts").alias("top_comments")), "note_id", "left").withColumn("top_comments", F.coalesce("top_comments", none))


def notes(rows: DataFrame, dictionary: tuple[str, ...] = (), shown: int = 3, width: int = 200) -> tuple[DataFrame, DataFrame]:
    """Rows as notes, and the rows that are none, with a warning each: those without an id, and those without title and text.

    A missing title is the text's beginning; keywords that are not given are those of the
    dictionary that the text holds; a stored heat stays, and is worked out where there is none.
    """
    title, content = tx.clean_text(F.col("title")), tx.clean_text(F.col("content"))
    own = rows.withColumns({"title": F.when((title == "") & (content != ""), F.substring(content, 1, 30)).otherwise(title), "content": content})
    warning = F.when(F.col("id").isNull(), "no id").when((F.col("title") == "") & (F.col("content") == ""), "no title and no text")
    own = own.withColumn("warning", warning)
    text = F.concat_ws(" ", "title", "content", "source_keyword")
    words = F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(tx.word_hits(text, dictionary))
    said = F.slice(F.filter(F.transform("top_comments", lambda c: F.substring(tx.clean_text(c), 1, width)), lambda c: c != ""), 1, shown)
    counts = [tx.int_count(F.col(c)) for c in COUNTS]
    good = own.where("warning is null").withColumns({"keywords": words, "top_comments": said, "heat_score": F.coalesce(F.col("heat_score").cast("double"), sc.heat_score(*counts))})
    good = good.withColumn("source_keyword", tx.first_text(tx.clean_text(F.col("source_keyword")), F.get("keywords", F.lit(0))))
    return good.drop("warning"), own.where("warning is not null").select("id", "warning")
