"""Scope, verification and delivery of web evidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions import text as tx

DEAD = (404, 410, 451)
PRIVATE = r"^(?i:https?)://(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.|\[)"


@dataclass(frozen=True)
class Policy:
    """What is in scope: the full names of the subject, an ambiguous short name, and domains by kind of source."""

    names: Sequence[str]
    short: str
    official: Sequence[str]
    news: Sequence[str]


def fetch_verdict(url: Column, status: Column, html: Column, quote: Column) -> Column:
    """What a fetched page says of a quote: verified, needs_review or rejected, by the first rule that holds."""
    return (
        F.when(~F.coalesce(url.rlike("^(?i:https?)://"), F.lit(False)), "rejected")
        .when(url.rlike(PRIVATE), "needs_review")
        .when(status.isin(*DEAD), "rejected")
        .when(~F.coalesce(status.between(200, 299), F.lit(False)), "needs_review")
        .when(tx.quote_found(html, quote), "verified")
        .otherwise("needs_review")
    )


def scope(kind: Column, domain: Column, title: Column, quote: Column, policy: Policy) -> Column:
    """in_scope, needs_review or out_of_scope of a hit, by the first rule that holds."""
    k, q = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.trim(F.coalesce(quote, F.lit("")))
    k = F.when(k == "official_notice", "official").otherwise(k)
    text = F.concat_ws(" ", F.trim(F.coalesce(title, F.lit(""))), q)
    named = F.size(tx.word_hits(F.lower(text), [n.lower() for n in policy.names])) > 0
    official, news = tx.domain_allowed(domain, policy.official), tx.domain_allowed(domain, policy.news)
    return (
        F.when((k == "") | (q == "") | (F.coalesce(domain, F.lit("")) == ""), "out_of_scope")
        .when(~k.isin("official", "news"), "needs_review")
        .when(~named & F.contains(text, F.lit(policy.short)), "needs_review")
        .when(~named, F.when((k == "official") & official, "in_scope").otherwise("out_of_scope"))
        .when(((k == "official") & official) | ((k == "news") & news), "in_scope")
        .otherwise("needs_review")
    )


def source_kind(host: Column, policy: Policy) -> Column:
    return F.when(tx.domain_allowed(host, policy.official), "official").when(tx.domain_allowed(host, policy.news), "news").otherwise("web")


def collect(hits: DataFrame, known: DataFrame, policy: Policy) -> DataFrame:
    """New hits (url, title, quote, seq) with canonical URL, its hash, kind and scope: the first of each page, unknown so far.

    Hits without a plain http URL or with a blank quote are left out.
    """
    own = hits.withColumn("canonical_url", tx.canonical_url(F.col("url"))).where("canonical_url is not null").where(F.trim(F.coalesce("quote", F.lit(""))) != "")
    own = own.withColumn("url_hash", F.sha2("canonical_url", 256)).withColumn("host", tx.host_of(F.col("canonical_url")))
    rest = [c for c in own.columns if c != "url_hash"]
    first = own.groupBy("url_hash").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("url_hash", "r.*")
    new = first.join(known.select("url_hash"), "url_hash", "left_anti").withColumn("kind", source_kind(F.col("host"), policy))
    return new.withColumn("scope", scope(F.col("kind"), F.col("host"), F.col("title"), F.col("quote"), policy))


def query_specs(queries: DataFrame, providers: Sequence[str], most: int = 10, version: str = "v1") -> DataFrame:
    """(provider, query, model, max_results, prompt_version): a search for each query (query, and provider, model, max_results or prompt_version where it has its own) and provider.

    A query without a provider goes to all of them. A blank query fails the job, since a search
    for nothing is a caller's mistake.
    """
    have = lambda c, d, kind: F.coalesce(F.col(c).cast(kind), d) if c in queries.columns else d
    text = F.trim(F.coalesce("query", F.lit("")))
    named = have("provider", F.lit(None).cast("string"), "string")
    own = queries.select(F.when(text == "", F.raise_error(F.lit("queries must not contain blank values"))).otherwise(text).alias("query"), F.explode(F.when(named.isNotNull(), F.array(F.lower(F.trim(named)))).otherwise(F.array(*map(F.lit, providers)))).alias("provider"), have("model", F.lit(None).cast("string"), "string").alias("model"), have("max_results", F.lit(most), "int").alias("max_results"), have("prompt_version", F.lit(version), "string").alias("prompt_version"))
    return own.select("provider", "query", "model", "max_results", "prompt_version")


def eligible(items: DataFrame) -> DataFrame:
    """Items that may be delivered: approved, in scope and verified, by id."""
    return items.where("review = 'approved' and scope = 'in_scope' and verification = 'verified'").orderBy("id")


def deliver(raw_posts: DataFrame, items: DataFrame) -> DataFrame:
    """raw_posts with the eligible items that are not there yet, keyed by URL hash; running it again changes nothing."""
    new = eligible(items).select(F.lit("web").alias("platform"), F.col("url_hash").alias("external_id"), "title", F.col("quote").alias("content"), F.col("canonical_url").alias("url")).dropDuplicates(["external_id"])
    return raw_posts.unionByName(new.join(raw_posts, ["platform", "external_id"], "left_anti"), allowMissingColumns=True)
