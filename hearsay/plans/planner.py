"""Which keywords to search for next: demand, gaps, heat and events, less what was searched lately."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators.relational import containers, decayed, normalised, quota


@dataclass(frozen=True)
class Weights:
    """Fixed values of the score."""

    ask_half_life: float = 3.0
    content_half_life: float = 7.0
    ask: float = 0.5
    gap: float = 0.3
    heat: float = 0.2
    event: float = 0.3
    scale: float = 10.0
    recent_penalty: float = 0.3
    barren_penalty: float = 0.1
    recent_days: float = 14.0
    few_hits: int = 3
    per_event: int = 3


def suggestions(queries: DataFrame, content: DataFrame, events: DataFrame, crawls: DataFrame, n: int = 10, w: Weights = Weights()) -> DataFrame:
    """(keyword, score, demand, gap, heat, event) of the n best keywords.

    queries: keyword, age, hits. content: keyword, engagement, age. events: keyword, event_key,
    signal, live. crawls: keyword, age, stored (latest run). Ages in days. A word that is part
    of exactly one longer asked word counts as that word. Keywords that only an event speaks
    for take at most per_event places each.
    """
    alias = containers(queries.select(F.col("keyword").alias("word")).distinct())
    own = queries.join(alias, queries.keyword == alias.word, "left").select(F.coalesce("container", "keyword").alias("keyword"), "age", "hits")
    ask = own.groupBy("keyword").agg(decayed(F.lit(1.0), F.col("age"), w.ask_half_life).alias("asked"), F.min_by("hits", "age").alias("last_hits"))
    warm = content.groupBy("keyword").agg(decayed(F.log10(1 + F.greatest("engagement", F.lit(0))), F.col("age"), w.content_half_life).alias("warm"))
    told = events.groupBy("keyword").agg(F.max(F.struct("signal", "event_key", "live")).alias("e"))
    seen = crawls.groupBy("keyword").agg(F.min(F.struct("age", "stored")).alias("c"))
    all_of = ask.join(warm, "keyword", "full").join(told, "keyword", "full").join(seen, "keyword", "left").na.fill(0.0, ["asked", "warm"])
    all_of = all_of.withColumn("demand", normalised(ask, "asked")).withColumn("heat", normalised(warm, "warm")).withColumn("event", F.coalesce("e.signal", F.lit(0.0)))
    gap = F.when(F.coalesce("last_hits", F.lit(99)) < w.few_hits, 1.0).otherwise(0.0)
    barren, recent = F.col("c.stored") == 0, F.col("c.age") < w.recent_days
    penalty = F.when(barren, w.barren_penalty).when(recent, w.recent_penalty).otherwise(1.0)
    # a live event still brings new posts, so only barren words are held back for it
    event_penalty = F.when(barren, w.barren_penalty).when(recent & ~F.coalesce(F.col("e.live"), F.lit(False)), w.recent_penalty).otherwise(1.0)
    base = w.ask * F.col("demand") + w.gap * F.least(2 * F.col("demand"), F.lit(1.0)) * gap + w.heat * F.col("heat")
    scored = all_of.withColumn("gap", gap).withColumn("score", F.round(base * F.coalesce(penalty, F.lit(1.0)) * w.scale + w.event * F.col("event") * F.coalesce(event_penalty, F.lit(1.0)) * w.scale, 4))
    only = (F.col("asked") == 0) & (F.col("warm") == 0)
    out = quota(scored.withColumn("event_key", F.col("e.event_key")), "event_key", only, [F.desc("score"), F.col("keyword")], w.per_event, n)
    return out.select("keyword", "score", "demand", "gap", "heat", "event")
