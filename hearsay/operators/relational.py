"""Ranking, counting and joining operators over posts, comments and events, as declarative plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.operators.order import running_counts, value_bounds, with_values


def midrank_percentile(df: DataFrame, group: str, score: str, out: str = "heat_rank") -> DataFrame:
    """Mid-rank percentile of a score in its group: 100 * (rows below + half of equal rows) / rows, two decimals.

    Hundredths are rounded as the double that they are: 0.575 lies below the half and becomes 0.57.
    A lone row has 50, equal scores have equal ranks, and all values lie strictly between 0 and
    100. A null score is the least. Rows are counted by ranges of the score (see order), so a group
    that holds most rows is spread over tasks, and so is a score that many rows have.
    """
    total = df.count()
    counts = running_counts(df, [group], score, value_bounds(df, score, total))
    ranks = counts.select(group, score, "n", (F.round((F.col("below") + F.col("n") / 2) * 100.0 / F.col("whole") * 100.0) / 100.0).alias(out))
    return with_values(df, ranks, [group, score], total)


def top_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, ranked from 1. Spark limits groups ahead of the shuffle."""
    keys = [group] if isinstance(group, str) else list(group)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def latest(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """The row with the greatest order value of each key."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def first_occurrence(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, in arrival order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def quota(df: DataFrame, group: str, limited: Column, order: Sequence[Column], per_group: int, n: int) -> DataFrame:
    """The first n rows in order, of which each group gives at most per_group limited ones."""
    place = F.row_number().over(Window.partitionBy(group, limited).orderBy(*order))
    return df.withColumn("_place", place).where(~limited | (F.col("_place") <= per_group)).drop("_place").orderBy(*order).limit(n)


def zero_filled_counts(df: DataFrame, label: str, domain: Sequence[str], default: str) -> DataFrame:
    """Counts of each label of a fixed domain, 0 where none; labels outside count as the default."""
    own = df.groupBy(F.when(F.col(label).isin(*domain), F.col(label)).otherwise(default).alias(label)).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(d,) for d in domain], f"{label} string")
    return every.join(own, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def daily_trend(df: DataFrame, at: str, days: int = 30) -> DataFrame:
    """(day, n) for the `days` days that end at the last day with data; days without rows have 0."""
    by_day = df.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    span = by_day.agg(F.max("day").alias("last")).where("last is not null")
    calendar = span.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return calendar.join(by_day, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def half_trend(df: DataFrame, at: str, now: str, days: int = 14) -> DataFrame:
    """One row: rows of the first and the second half of the last days, of unknown time, and whether they grow."""
    age = (F.lit(now).cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double")) / 86400
    first, second = F.count_if((age >= days / 2) & (age < days)), F.count_if((age >= 0) & (age < days / 2))
    return df.agg(first.alias("first_half"), second.alias("second_half"), F.count_if(F.col(at).isNull()).alias("undated")).withColumn("growing", F.col("second_half") > F.col("first_half"))


def top_with_other(df: DataFrame, label: str, n: int = 4) -> DataFrame:
    """(label, n, width): the n most frequent labels, the rest as 'other'; width relative to the greatest, in percent."""
    count = df.groupBy(label).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), label))
    own = count.withColumn("_p", place).groupBy(F.when(F.col("_p") <= n, F.col(label)).otherwise("other").alias(label)).agg(F.sum("n").alias("n"))
    return own.withColumn("width", F.round(100.0 * F.col("n") / F.max("n").over(Window.partitionBy()), 2))


def decayed(weight: Column, age: Column, half_life: float) -> Column:
    """Sum of weights that halve with each half life; ages under 0 count as 0."""
    return F.sum(weight * F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life))


def normalised(df: DataFrame, x: str) -> Column:
    """A column of df over its greatest value of all rows, 0 where that is 0; the greatest is an aggregate of its own, so no task gets all rows."""
    top = df.agg(F.max(x)).scalar()
    return F.when(top > 0, F.col(x) / top).otherwise(0.0)


def routed_comments(posts: DataFrame, comments: DataFrame, n: int = 3, width: int = 200) -> DataFrame:
    """(platform, post_id, comments): up to n comments of each post with text, by likes, then time, newest first."""
    own = comments.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    own = own.join(posts.select("platform", "post_id").distinct(), ["platform", "post_id"], "left_semi")
    best = top_per_group(own, ["platform", "post_id"], [F.desc("likes"), F.desc("at"), "comment_id"], n)
    return best.groupBy("platform", "post_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, width).alias("text")))), lambda c: c["text"]).alias("comments"))


def replies(comments: DataFrame) -> DataFrame:
    """(comment_id, replies): the replies to each top-level comment in order of id; orphans are dropped."""
    reply = comments.where("parent_id is not null").groupBy(F.col("parent_id").alias("comment_id")).agg(F.array_sort(F.collect_list("comment_id")).alias("replies"))
    return comments.where("parent_id is null").select("comment_id").join(reply, "comment_id", "left").select("comment_id", F.coalesce("replies", F.array().cast("array<long>")).alias("replies"))


def ordered_fetch(df: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
    """Rows of a list of ids, with their place in the list; ids without rows are left out."""
    wanted = df.sparkSession.createDataFrame([(list(ids),)], "ids array<long>").select(F.posexplode("ids").alias("place", key))
    return df.join(wanted, key)


def work_list(left: DataFrame, right: DataFrame, active: DataFrame) -> DataFrame:
    """Every platform with every keyword (both short lists), but for pairs that are active already."""
    return left.crossJoin(right).join(active, [*left.columns, *right.columns], "left_anti")


def hybrid_union(literal: DataFrame, semantic: DataFrame, key: str, order: str, n: int, alone: float = 0.60, backed: float = 0.55) -> DataFrame:
    """Literal hits, then semantic ones not among them, up to n rows.

    A semantic hit needs a similarity of `backed` where there are literal hits, else `alone`.
    """
    some = literal.limit(1).agg((F.count("*") > 0).alias("_some"))
    extra = semantic.join(literal, key, "left_anti").join(F.broadcast(some), F.lit(True)).where(F.col(order) >= F.when(F.col("_some"), backed).otherwise(alone))
    own = literal.select(key).withColumn("tier", F.lit(0)).withColumn(order, F.lit(None).cast("double"))
    return own.unionByName(extra.select(key, F.lit(1).alias("tier"), order)).orderBy("tier", F.desc(order), key).limit(n)


def containers(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, container) of words that occur within exactly one other, longer word of a short list of words."""
    a, b = words.select(F.col(word).alias("word")), words.select(F.col(word).alias("container"))
    # candidates share a trigram, or the whole of a shorter word, so most pairs never meet
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    left = a.withColumn("g", F.substring("word", 1, 2))
    right = b.withColumn("g", F.explode(F.array_distinct(grams(F.col("container")))))
    pair = left.join(right, "g").where((F.length("container") > F.length("word")) & F.contains("container", F.col("word"))).select("word", "container").distinct()
    return pair.groupBy("word").agg(F.count("*").alias("n"), F.min("container").alias("container")).where("n = 1").select("word", "container")


def duplicate_probe(df: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), *keys).limit(n)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page of rows in order; the order has to end in a key."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
