"""Records that people and runs leave: comments, submissions, reviews, run logs, audit rows, deliveries, and their rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions import score as sc
from hearsay.functions import text as tx
from hearsay.operators.order import global_places, looked_up

#: Reports that hide a comment, and the longest texts.
HIDING_REPORTS = 5
COMMENT_CHARS, TITLE_CHARS, CONTENT_CHARS, IMAGES = 300, 100, 5000, 9


def rule_mood(text: Column) -> Column:
    """Sentiment of a text by word lists alone."""
    zero = F.lit(0)
    return sc.note_risk(tx.clean_text(text), F.lit("neutral"), F.lit("low"), zero, zero, F.lit(0.0), F.lit(0.0))["sentiment"]


def checked_comments(comments: DataFrame, events: DataFrame, known: DataFrame) -> DataFrame:
    """New comments (id, event_id, user_id, username, content, parent_id) with content as stored, sentiment, and error, null if a comment may be stored.

    events: id, status. known: id, event_id, parent_id of stored comments. The first rule that a
    comment breaks is its error: the event has to exist and be published, the text not be blank
    nor too long, and an answer go to a top-level comment of the same event.
    """
    # texts are judged where they are read, before a much commented event's rows move
    own = comments.withColumn("content", tx.sanitized(F.trim(F.coalesce("content", F.lit("")))))
    own = own.withColumn("sentiment", rule_mood(F.col("content")))
    own = looked_up(own, events.select(F.col("id").alias("event_id"), "status"), "event_id", "event", comments)
    own = looked_up(own, known.select(F.col("id").alias("parent_id"), "event_id", F.col("parent_id").alias("above")), "parent_id", "parent", comments)
    error = (
        F.when(F.col("event.status").isNull(), "no such event")
        .when(F.col("event.status") != "published", "not published")
        .when(F.col("content") == "", "empty")
        .when(F.length("content") > COMMENT_CHARS, "too long")
        .when(F.col("parent_id").isNotNull() & ~F.col("parent.event_id").eqNullSafe(F.col("event_id")), "no such comment")
        .when(F.col("parent.above").isNotNull(), "only one level")
    )
    name = F.coalesce(F.nullif("username", F.lit("")), F.concat(F.lit("用户"), F.col("user_id").cast("string")))
    return own.select("id", "event_id", "user_id", name.alias("username"), "parent_id", "content", "sentiment", error.alias("error"))


def reported(comments: DataFrame, reports: DataFrame) -> DataFrame:
    """Comments (id, status, report_count) after reports (comment_id): counts added up, and visible ones hidden once they have HIDING_REPORTS."""
    more = reports.groupBy(F.col("comment_id").alias("id")).agg(F.count("*").alias("more"))
    own = comments.join(more, "id", "left").withColumn("report_count", F.col("report_count") + F.coalesce("more", F.lit(0)))
    hide = (F.col("status") == "visible") & (F.col("more") > 0) & (F.col("report_count") >= HIDING_REPORTS)
    return own.withColumn("status", F.when(hide, "hidden").otherwise(F.col("status"))).drop("more")


def checked_submissions(rows: DataFrame) -> DataFrame:
    """Submissions (id, user_id, title, content, images) with title and text as stored, distinct images, and error, null if one may be stored."""
    own = rows.withColumns({c: tx.sanitized(F.trim(F.coalesce(c, F.lit("")))) for c in ("title", "content")}).withColumn("images", F.array_distinct(F.coalesce("images", F.array().cast("array<string>"))))
    error = F.when(F.col("title") == "", "no title").when(F.length("title") > TITLE_CHARS, "title too long").when(F.col("content") == "", "no text").when(F.length("content") > CONTENT_CHARS, "text too long").when(F.size("images") > IMAGES, "too many images")
    return own.withColumn("error", error)


def reviewed(submissions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions (id, status, title, content, username, created_at) after decisions (id, approve, comment), and the raw posts of approved ones.

    Only pending ones are decided, each once; a rejection without a reason is not taken.
    """
    valid = decisions.where(F.col("approve") | (F.trim(F.coalesce("comment", F.lit(""))) != "")).groupBy("id").agg(F.max(F.struct("approve", "comment")).alias("d"))
    own = submissions.join(valid, "id", "left")
    decided = (F.col("status") == "pending") & F.col("d").isNotNull()
    status = F.when(decided, F.when(F.col("d.approve"), "approved").otherwise("rejected")).otherwise(F.col("status"))
    raw = own.where(decided & F.col("d.approve")).select(F.lit("campus").alias("platform"), F.concat(F.lit("sub:"), F.col("id").cast("string")).alias("external_id"), "title", "content", F.col("username").alias("author"), F.col("created_at").alias("publish_time"))
    return own.withColumn("status", status).drop("d"), raw


def run_logs(payloads: DataFrame, now: Column) -> DataFrame:
    """Log rows of runs from JSON payloads (run_id, payload): missing counts are 0, a missing status is success, a missing start is now."""
    p = F.from_json("payload", "agent_type string, keyword string, input_count string, output_count string, status string, error_message string, duration_ms string, started_at string, finished_at string")
    own = payloads.select("run_id", p.alias("p"))
    text = lambda c, d="": F.coalesce(f"p.{c}", F.lit(d)).alias(c)
    count = lambda c: F.coalesce(F.col(f"p.{c}").try_cast("double").cast("long"), F.lit(0)).alias(c)
    return own.select("run_id", text("agent_type", "public_opinion"), text("keyword"), count("input_count"), count("output_count"), text("status", "success"), text("error_message"), count("duration_ms"), F.coalesce(F.try_to_timestamp("p.started_at"), now).alias("started_at"), F.try_to_timestamp("p.finished_at").alias("finished_at"))


def merged_summary(summary: Column, extra: Column) -> Column:
    """A run's JSON summary with more fields, which win; a summary that is no object is kept under `original`."""
    own = F.when(F.startswith(F.trim(summary), F.lit("{")), F.from_json(summary, "map<string,string>"))
    kept = F.coalesce(own, F.when(F.coalesce(summary, F.lit("")) == "", F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("original"), summary)))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(kept, lambda k, v: ~F.map_contains_key(extra, k)), extra)))))


def audit_rows(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, action, detail): one row for each row that was created, changed or deleted, with both states as JSON."""
    side = lambda df, name: df.select(key, F.to_json(F.struct(*columns)).alias(name))
    both = side(before, "old").join(side(after, "new"), key, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    action = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").otherwise("update")
    return both.select(key, action.alias("action"), F.concat(F.lit('{"before_json":'), F.coalesce("old", F.lit("{}")), F.lit(',"after_json":'), F.coalesce("new", F.lit("{}")), F.lit("}")).alias("detail"))


def task_records(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Tasks (task_id) with counts of their outcomes (task_id, ok) and a status: failed if all failed, partial if some did, running without any."""
    done = outcomes.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if("ok").alias("success"))
    own = tasks.join(done, "task_id", "left").na.fill(0, ["total", "success"]).withColumn("failed", F.col("total") - F.col("success"))
    return own.withColumn("status", F.when(F.col("total") == 0, "running").when(F.col("failed") == 0, "success").when(F.col("success") == 0, "failed").otherwise("partial"))


def delivery_batches(items: DataFrame, size: int = 100) -> DataFrame:
    """Eligible items (id, url_hash, review, scope, verification) dealt to batches of `size` in order of id: (batch, id, url_hash)."""
    own = items.where("review = 'approved' and scope = 'in_scope' and verification = 'verified'")
    own = global_places(own.select("id", "url_hash"), F.col("id"), [F.col("id")], "_place")
    return own.withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")


def pending_keywords(queue: DataFrame, platform: str | None = None) -> DataFrame:
    """(keyword, place): distinct keywords of pending tasks (id, keyword, status, platform), in the order that they came in."""
    own = queue.where("status = 'pending'")
    own = own.where(F.col("platform") == platform) if platform else own
    first = own.where(F.trim("keyword") != "").groupBy(F.trim("keyword").alias("keyword")).agg(F.min("id").alias("id"))
    return global_places(first, F.col("id"), [F.col("id"), F.col("keyword")]).select("keyword", "place")


def upserted_counts(stored: DataFrame, new: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """Stored rows with the counts of new rows of the same key, and new rows that were not there; nothing else of a stored row changes."""
    fresh = new.groupBy(key).agg(F.max(F.struct(*(c for c in stored.columns if c != key))).alias("n"))
    own = stored.withColumn("s", F.struct(*(c for c in stored.columns if c != key))).select(key, "s").join(fresh, key, "full")
    pick = lambda c: F.coalesce(f"n.{c}", f"s.{c}") if c in counts else F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"n.{c}"))
    return own.select(*(F.col(key) if c == key else pick(c).alias(c) for c in stored.columns))


def content_signals(posts: DataFrame, now: Column, days: float = 14.0) -> tuple[DataFrame, DataFrame]:
    """Of posts (source_keyword, tags, engagement, publish_time): (keyword, engagement, age) of recent ones by each of their words, and (keyword, age) of the last post by keyword."""
    own = posts.where("publish_time is not null").withColumn("age", sc.age_days(F.col("publish_time"), now)).withColumn("source_keyword", F.trim(F.coalesce("source_keyword", F.lit(""))))
    word = F.array_distinct(F.filter(F.concat(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t)), F.array("source_keyword")), lambda t: t != ""))
    stats = own.where(F.col("age") <= days).select(F.explode(word).alias("keyword"), "engagement", "age")
    return stats, own.where("source_keyword <> ''").groupBy(F.col("source_keyword").alias("keyword")).agg(F.min("age").alias("age"))
