"""Answers of search services as rows: loose JSON read as VARIANT, whatever its shape, and what is no evidence left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions import text as tx

# Names that a field goes by, in order; results and characters of a web search that are kept.
LISTS = ("hits", "results", "items")
QUOTES = ("quote", "evidence_quote", "evidence", "snippet", "text")
REQUESTS, MODELS, PROVIDERS = ("request_id", "requestId", "id"), ("model", "model_name"), ("provider", "provider_id")
RESULTS, CONTENT_CHARS = 8, 500


def field(value: Column, names: Sequence[str]) -> Column:
    """The VARIANT under the first of the names that an object has, be it null."""
    return F.coalesce(*(F.try_variant_get(value, f"$.{n}", "variant") for n in names))


def kind(value: Column) -> Column:
    """What a VARIANT holds: ARRAY, OBJECT, STRING and so on; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def told(value: Column) -> Column:
    """A VARIANT as text without blanks at its ends; empty for null, missing, 0 and false."""
    x = tx.stripped(F.try_variant_get(value, "$", "string"))
    return F.when(x.isin("0", "false"), "").otherwise(x)


def listed(body: Column) -> Column:
    """The items of an answer: a list itself, or what the first of LISTS holds, a list or one object; null for anything else."""
    v = F.try_parse_json(body)
    inner = field(v, LISTS)
    many = F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(kind(inner) == "ARRAY", F.try_variant_get(inner, "$", "array<variant>"))
    return F.coalesce(many, F.when(kind(inner) == "OBJECT", F.array(inner)))


def search_hits(answers: DataFrame) -> DataFrame:
    """(id, place, url, title, quote, provider, model, request_id) of answers (id, provider, body): one row for each hit that is evidence.

    A hit is an object with an http(s) address and a quote that isn't blank, under one of QUOTES;
    of these the first that is there counts, even if it holds no text. One that names another
    provider than the answer's is left out. Model and request are the hit's own or else the
    answer's. place is the hit's place in the answer, from 0. A body that is no JSON has no hits.
    """
    v = F.try_parse_json("body")
    whole = F.when(kind(v) == "OBJECT", v)
    own = answers.select("id", "provider", told(field(whole, REQUESTS)).alias("request"), told(field(whole, MODELS)).alias("asked"), F.posexplode(listed(F.col("body"))).alias("place", "hit")).where(kind(F.col("hit")) == "OBJECT")
    hit = F.col("hit")
    text = lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string"))
    named = tx.first_text(*(told(field(hit, [p])) for p in PROVIDERS))
    out = own.select(
        "id",
        F.col("place").cast("long").alias("place"),
        text(field(hit, ["url"])).alias("url"),
        tx.stripped(text(field(hit, ["title"]))).alias("title"),
        text(field(hit, QUOTES)).alias("quote"),
        named.alias("named"),
        tx.first_text(F.col("provider")).alias("given"),
        tx.first_text(told(field(hit, MODELS)), F.col("asked")).alias("model"),
        tx.first_text(told(field(hit, REQUESTS[:2])), F.col("request")).alias("request_id"),
    )
    same = (F.col("named") == "") | (F.col("given") == "") | (F.lower("named") == F.lower(tx.stripped(F.col("given"))))
    good = F.lower(F.trim("url")).rlike("^https?:") & (tx.stripped(F.col("quote")) != "") & same
    return out.where(F.coalesce(good, F.lit(False))).select("id", "place", F.trim("url").alias("url"), "title", "quote", tx.first_text(F.col("named"), F.col("given")).alias("provider"), "model", "request_id")


def web_results(answers: DataFrame, most: int = RESULTS, chars: int = CONTENT_CHARS) -> DataFrame:
    """(id, place, title, link, media, publish_date, content) of answers (id, body): the first `most` results of a web search that have an address.

    Fields are text whatever they hold, empty where they lack; contents are cut to `chars`. Every text
    passes the prompt guard, as pages are not to be trusted. place counts kept results from 1.
    """
    found = F.try_variant_get(F.try_parse_json("body"), "$.search_result", "array<variant>")
    own = answers.select("id", F.posexplode(found).alias("at", "hit"))
    names = ("title", "media", "publish_date", "content")
    text = lambda n: F.coalesce(F.try_variant_get("hit", f"$.{n}", "string"), F.lit(""))
    own = own.select("id", "at", tx.stripped(text("link")).alias("link"), *(text(n).alias(n) for n in names)).where(F.col("link").rlike("^https?://"))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("at")).cast("long")).where(F.col("place") <= most)
    own = own.withColumn("content", F.substring("content", 1, chars))
    return own.select("id", "place", "link", *(tx.sanitized(F.col(n)).alias(n) for n in names))
