"""Events with the help of injected models: what they see, how answers are checked, and what holds where they fail."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions import models as md
from hearsay.functions import text as tx
from hearsay.operators import cluster as cl
from hearsay.operators.lineage import cut
from hearsay.operators.vectors import similar_pairs

#: States that a model may name, and the longest reason.
JUDGED = ("resolved", "ongoing", "not_applicable")
REASON = 60


def checked_lifecycle(answer: Column) -> Column:
    """struct(lifecycle, reason) of a model's JSON answer {lifecycle, lifecycle_reason}, or null.

    A model reads what is at stake but not whether posts still come, so its 'escalating' counts
    as ongoing. An unknown state, or one without a reason, is no answer.
    """
    told = F.from_json(answer, "lifecycle string, lifecycle_reason string")
    state = F.lower(F.trim(told["lifecycle"]))
    state = F.when(state == "escalating", "ongoing").otherwise(state)
    reason = F.substring(F.trim(told["lifecycle_reason"]), 1, REASON)
    return F.when(state.isin(*JUDGED) & (reason != ""), F.struct(state.alias("lifecycle"), reason.alias("reason")))


def assess_lifecycles(events: DataFrame, inputs: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """events with lifecycle_judgement and lifecycle_reason; both are empty where there is no text, no answer, or no usable one.

    inputs: event_key, texts. The model gets the event's title and its texts, in one call each.
    """
    asked = events.select("event_key", "title").join(inputs.where(F.size("texts") > 0), "event_key").select("event_key", F.to_json(F.struct("title", "texts")).alias("ask"))
    told = md.mapped_calls(asked, "event_key", "ask", call).select("event_key", checked_lifecycle(F.col("answer")).alias("told"))
    own = events.join(told, "event_key", "left")
    return own.select(*events.columns, F.coalesce("told.lifecycle", F.lit("")).alias("lifecycle_judgement"), F.coalesce("told.reason", F.lit("")).alias("lifecycle_reason"))


def proposed_keywords(events: DataFrame, inputs: DataFrame, call: Callable[[str], str], *, top: int = 5, most: int = 5, prefixes: Sequence[str] = (), banned: Sequence[str] = ()) -> DataFrame:
    """(event_key, place, keyword): words that a model proposes for the `top` events by priority, at most `most` each.

    An answer is a JSON list of words, or an object with such a list as keywords; a bare string
    is none. Words are normalised as keywords are, and those that are left empty or that came
    before are dropped ahead of the limit.
    """
    first = events.orderBy(F.desc("priority"), "event_key").limit(top).select("event_key", "title", "risk_level", "lifecycle")
    asked = first.join(inputs.where(F.size("texts") > 0), "event_key").select("event_key", F.to_json(F.struct("title", "texts", "risk_level", "lifecycle")).alias("ask"))
    told = md.mapped_calls(asked, "event_key", "ask", call)
    words = F.coalesce(F.from_json("answer", "array<string>"), F.from_json("answer", "keywords array<string>")["keywords"])
    word = told.select("event_key", F.posexplode(words).alias("at", "word")).withColumn("keyword", tx.normal_keyword(F.trim("word"), prefixes, banned)).where("keyword <> ''")
    once = word.groupBy("event_key", "keyword").agg(F.min("at").alias("at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("event_key").orderBy("at"))).where(F.col("place") <= most).select("event_key", "place", "keyword")


def matched_events(questions: DataFrame, titles: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """(question_id, event): which of its listed titles a model takes a question's keyword for, null for none.

    questions: question_id, keyword; titles: question_id, title, place. An answer {"event": title}
    counts only if the list has that title word for word, so an invented event is none. A call
    that fails leaves the question without an answer.
    """
    own = titles.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda s: s["title"]).alias("titles"))
    asked = questions.where(F.coalesce("keyword", F.lit("")) != "").join(own, "question_id")
    told = md.mapped_calls(asked.select("question_id", F.to_json(F.struct("keyword", "titles")).alias("ask")), "question_id", "ask", call)
    event = F.from_json("answer", "event string")["event"]
    chosen = asked.join(told, "question_id").select("question_id", F.when(F.array_contains("titles", event), event).alias("event"))
    return questions.select("question_id").join(chosen, "question_id", "left")


def verdict_is_same(answer: Column) -> Column:
    """True or false from a judge's answer, a bare boolean or {"same_event": boolean}; null where it is neither."""
    bare = F.lower(F.trim(answer))
    return F.when(bare == "true", True).when(bare == "false", False).otherwise(F.from_json(answer, "same_event boolean")["same_event"])


def judged_pairs(pairs: DataFrame, briefs: DataFrame, call: Callable[[str], str], most: int = 12) -> DataFrame:
    """(a, b, similarity, same) of the `most` most similar grey pairs of clusters (a, b, similarity) by a judge that sees both briefs.

    briefs: cluster and what describes it. A judge that fails or gives no verdict keeps the pair apart.
    """
    top = pairs.orderBy(F.desc("similarity"), "a", "b").limit(most).withColumn("pair", F.concat_ws("|", "a", "b"))
    side = lambda key, name: briefs.select(F.col("cluster").alias(key), F.struct(*(c for c in briefs.columns if c != "cluster")).alias(name))
    asked = top.join(side("a", "first"), "a").join(side("b", "second"), "b").select("pair", F.to_json(F.struct(F.col("first").alias("a"), F.col("second").alias("b"))).alias("ask"))
    told = md.mapped_calls(asked, "pair", "ask", call).select("pair", verdict_is_same(F.col("answer")).alias("same"))
    return top.join(told, "pair", "left").select("a", "b", "similarity", F.coalesce("same", F.lit(False)).alias("same"))


def merged_by_verdict(pairs: DataFrame) -> DataFrame:
    """(gone, into): clusters that go into another by judged pairs (a, b, similarity, same), best pair first; a pair with a cluster that is gone is passed over.

    The pairs are the few that a judge was asked about, so they come to the driver.
    """
    gone: dict = {}
    for r in sorted(pairs.where("same").collect(), key=lambda r: (-r.similarity, r.a, r.b)):
        if r.a not in gone and r.b not in gone:
            gone[r.b] = r.a
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.sparkSession.createDataFrame(sorted(gone.items()), f"gone {kind}, into {kind}")


def aligned(new: DataFrame, old: DataFrame, threshold: float = cl.ALIGN, rounds: int = 100) -> DataFrame:
    """(key, old_key, similarity): new centroids (key, centroid) matched one to one with old ones, most similar pairs first.

    In each round, pairs that are the best of both their sides are taken, and all other pairs of
    those sides go. That is the greedy choice over the sorted pairs, without a sorted list
    anywhere. Keys decide ties. Pairs above the threshold come from cells of near vectors (see
    similar_pairs), and each round is cut off from those before.
    """
    left, taken = cut(similar_pairs(new, old, threshold).withColumnRenamed("similarity", "s")), []
    for _ in range(rounds):
        if left.isEmpty():
            break
        order = F.struct("s", "a", "b")
        best = cut(left.groupBy("a").agg(F.max(order).alias("m")).select("m.*").join(left.groupBy("b").agg(F.max(order).alias("m")).select("m.*"), ["a", "b", "s"]))
        taken.append(best)
        left = cut(left.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti"))
    else:
        raise ValueError("the pairs were not matched in the rounds given")
    out = left.limit(0)
    for t in taken:
        out = out.unionByName(t.select("a", "b", "s"))
    return out.select(F.col("a").alias("key"), F.col("b").alias("old_key"), F.col("s").alias("similarity"))


def semantic_events(posts: DataFrame, block: str = "block", *, least: int = 2, previous: DataFrame | None = None, threshold: float = cl.THRESHOLD, merge: float = cl.MERGE, span_days: float = cl.SPAN_DAYS) -> DataFrame:
    """(event_key, title, size, note_ids, ranking): events of posts by meaning, larger ones first.

    posts: block, id, rank_key, at_days, vector, title, keyword. Clusters (see greedy_clusters) of
    fewer than `least` posts are no events. One that lies near a centroid of the previous run
    (key, title, centroid) takes its key and title; another is named by its most frequent keyword,
    or else its head post's title, and its key is a hash of the head's title. Keys that collide
    are told apart by the cluster's smallest id.
    """
    label = cl.greedy_clusters(posts, block, threshold=threshold, merge=merge, span_days=span_days)
    member = label.join(posts, [block, "id"]).withColumn("cluster", F.concat_ws(":", F.col(block).cast("string"), F.col("cluster").cast("string")))
    size = member.groupBy("cluster").agg(F.count("*").alias("size"), F.max_by("title", F.struct("rank_key", "id")).alias("head"), F.min("id").alias("first_id"), F.array_sort(F.collect_list("id")).alias("note_ids"), F.sum("rank_key").alias("ranking")).where(F.col("size") >= least)
    word = member.where("keyword <> ''").groupBy("cluster", "keyword").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.min_by("keyword", F.struct(-F.col("n"), F.col("keyword"))).alias("word"))
    fresh = F.concat(F.lit("sem:"), F.substring(F.sha1(F.coalesce("head", F.lit(""))), 1, 8))
    event = size.join(word, "cluster", "left").withColumn("fresh", fresh).withColumn("name", F.coalesce("word", "head", F.lit("")))
    twin = F.row_number().over(Window.partitionBy("fresh").orderBy("first_id"))
    event = event.withColumn("fresh", F.when(twin > 1, F.concat_ws("-", "fresh", F.col("first_id").cast("string"))).otherwise(F.col("fresh")))
    if previous is not None:
        centre = cl.centroids(member.join(size.select("cluster"), "cluster", "left_semi"), "cluster", "vector", "id").select(F.col("cluster").alias("key"), "centroid")
        kept = aligned(centre, previous.select("key", "centroid")).join(previous.select(F.col("key").alias("old_key"), F.col("title").alias("old_title")), "old_key")
        event = event.join(kept.select(F.col("key").alias("cluster"), "old_key", "old_title"), "cluster", "left").withColumn("fresh", F.coalesce("old_key", "fresh")).withColumn("name", F.coalesce(F.nullif("old_title", F.lit("")), "name"))
    return event.select(F.col("fresh").alias("event_key"), F.col("name").alias("title"), "size", "note_ids", F.col("ranking").alias("ranking")).orderBy(F.desc("size"), "note_ids")
