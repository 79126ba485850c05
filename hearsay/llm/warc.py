"""Resolving not-modified revisits of an archive to the response that they confirm, on built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.operators.order import range_of

#: Header fields that a 304 response may set anew (fixed values of RFC 9110, section 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Stretches of captures that those of one URL are searched in side by side: at least, captures of one beyond that, and at most.
PARTS, PART_ROWS, MOST_PARTS = 1024, 1 << 20, 16_384


def canonical_url(url: Column) -> Column:
    """Host without www and default port, path without a closing slash, sorted query without tracking parameters; no scheme or fragment."""
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(whole, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(whole, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.when(F.contains(rest, F.lit("?")), F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise(""), "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_"))))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _lower_names(headers: Column) -> Column:
    """A header map by lower-case names; of names that differ in case only, the first counts."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.get(F.filter(entries, lambda e: F.lower(e["key"]) == k), F.lit(0))["value"]))


def latest_response(records: DataFrame) -> DataFrame:
    """(record_id, response_id) of each revisit: the latest full response to the same canonical URL before it.

    An as-of join by windows. All captures in order of time are cut into stretches of about as many
    rows, PARTS or more, by a sketch of the times; a moment that fills stretches of its own, as in a
    burst, is cut by record_id. Within a stretch a window finds the last response, and across
    stretches the last one of any stretch before, of which a URL has one row each. So a URL's
    captures, however many and whenever, are spread over tasks, and a wrong date changes no
    other's stretch. Rows that share a record_id give one row.
    """
    own = records.where("ts is not null and url_key is not null").select("record_id", "url_key", "ts", "full")
    own = own.withColumn("part", _stretch(own))
    response = F.when(F.col("full"), F.col("record_id"))
    along = Window.partitionBy("url_key", "part").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = own.withColumn("near", F.last(response, ignorenulls=True).over(along))
    last = own.where("full").groupBy("url_key", "part").agg(F.max(F.struct("ts", "record_id")).alias("last"))
    stretch = own.groupBy("url_key", "part").agg(F.count("*").alias("n")).join(last, ["url_key", "part"], "left")
    carried = F.last("last.record_id", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    stretch = stretch.select("url_key", "part", carried.alias("far"))
    found = near.where("not full").join(stretch, ["url_key", "part"]).select("record_id", F.coalesce("near", "far").alias("response_id"))
    return found.groupBy("record_id").agg(F.max("response_id").alias("response_id"))


def _stretch(own: DataFrame) -> Column:
    """The number of a row's stretch; it grows along (ts, record_id)."""
    parts = min(MOST_PARTS, max(PARTS, own.count() // PART_ROWS))
    cuts = [F.percentile_approx(c, [i / parts for i in range(1, parts)], 20 * parts).alias(c) for c in ("ts", "record_id")]
    times, ids = own.agg(*cuts).first()
    if not times:
        return F.lit(0)
    crowded = sorted({a for a, b in zip(times, times[1:], strict=False) if a == b})
    bounds = sorted({*times, *crowded, *(t + 1 for t in crowded)})
    within = F.when(F.col("ts").isin(crowded), range_of(F.col("record_id").cast("double"), sorted(set(ids)))).otherwise(0) if crowded else F.lit(0)
    return range_of(F.col("ts").cast("double"), bounds).cast("long") * (parts + 1) + within


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit with what it stands for: record_id, url_key, ts, verdict, response_id, headers, payload.

    records has record_id, url, ts (long), type ('response' or 'revisit'), status, headers (map of
    strings) and payload. A full response has type 'response' and status 200. verdict is
    'resolved', 'validators differ' or 'no response'. An entity tag decides if the revisit has
    one, compared weakly; else Last-Modified; a revisit with neither fits only a response with
    neither. A resolved revisit has the response's payload, and its headers with the fields of
    PERMITTED that the revisit sets; others have nulls there.

    Nulls: without url or ts a record is never resolved nor stands for another; null headers are
    none. record_id is a key, so k rows of a revisit give k rows, and rows of a response stand for
    one; at equal ts the smaller is earlier. Payloads of any length go through one shuffle. Other
    columns are ignored.
    """
    own = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", F.coalesce((F.col("type") == "response") & (F.col("status") == 200), F.lit(False)).alias("full"), F.coalesce(F.col("type") == "revisit", F.lit(False)).alias("revisit"), _lower_names(F.col("headers")).alias("headers"), "payload")
    pair = latest_response(own.where("full or revisit").drop("headers", "payload"))
    response = own.where("full").select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"), "payload").dropDuplicates(["response_id"])
    found = own.where("revisit").drop("payload").join(pair, "record_id", "left")
    # revisits without a response are spread by their own hash; what they may meet there is dropped
    met = F.coalesce("found_id", F.xxhash64("record_id", F.lit("none")))
    found = found.withColumnRenamed("response_id", "found_id").withColumn("met", met).join(response.withColumnRenamed("response_id", "met"), "met", "left")
    found = found.withColumns({c: F.when(F.col("found_id").isNotNull(), F.col(c)) for c in ("stored", "payload")}).withColumnRenamed("found_id", "response_id").drop("met")
    tag = [F.regexp_replace(F.col(h)["etag"], "^W/", "") for h in ("headers", "stored")]
    date = [F.col(h)["last-modified"] for h in ("headers", "stored")]
    same = F.when(tag[0].isNotNull(), tag[0] == tag[1]).when(date[0].isNotNull(), date[0] == date[1]).otherwise(tag[1].isNull() & date[1].isNull())
    verdict = F.when(F.col("stored").isNull(), "no response").when(F.coalesce(same, F.lit(False)), "resolved").otherwise("validators differ")
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    ok = F.col("verdict") == "resolved"
    return found.withColumn("verdict", verdict).select("record_id", "url_key", "ts", "verdict", F.when(ok, F.col("response_id")).alias("response_id"), F.when(ok, merged).alias("headers"), F.when(ok, F.col("payload")).alias("payload"))


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records for pages (page_id, url, html): a full response to each at second page_id, and a revisit 500 seconds later.

    Every fifth revisit names another entity tag, and every seventh has a date only. A revisit
    also carries a field that a 304 response may not set.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.expr("cast(page_id div 100 as string)"))
    response = pages.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("type"), F.lit(200).alias("status"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"), F.col("html").alias("payload"))
    told = F.when(F.expr("page_id % 5 = 0"), F.create_map(F.lit("etag"), F.lit('"other"'))).when(F.expr("page_id % 7 = 0"), F.create_map(F.lit("last-modified"), day)).otherwise(F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag)))
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + 500).alias("ts"), F.lit("revisit").alias("type"), F.lit(304).alias("status"), F.map_concat(told, F.create_map(F.lit("Cache-Control"), F.lit("max-age=120"), F.lit("Content-Type"), F.lit("none"))).alias("headers"), F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)
