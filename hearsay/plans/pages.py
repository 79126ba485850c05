"""Rows of raw web pages: embedded state and linked data as JSON, links resolved against the page, and posts among them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions import text as tx


def balanced(page: str, start: int) -> int:
    """Where the JSON object or list that begins at `start` ends (one beyond its last bracket); -1 if it doesn't. Brackets within strings don't count."""
    closing, at, n = [], start, len(page)
    while at < n:
        c = page[at]
        if c == '"':
            at += 1
            while at < n and page[at] != '"':
                at += 2 if page[at] == "\\" else 1
        elif c in "{[":
            closing.append("}" if c == "{" else "]")
        elif c in "}]":
            if not closing or closing.pop() != c:
                return -1
            if not closing:
                return at + 1
        at += 1
    return -1


def state_of(pages: DataFrame, marker: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, place, json): every object or list that follows `marker` (a key or a variable's name) and `:` or `=` in a page, whole, in order.

    What is cut off or not balanced is passed over, and an inner marker of a found one is not looked
    for again. Null pages have none.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def found(page: str) -> Iterator[str]:
        at = 0
        while (at := page.find(marker, at)) >= 0:
            at += len(marker)
            begin = at
            while begin < len(page) and page[begin] in " \t\r\n\"':=":
                begin += 1
            if begin > at and page[begin : begin + 1] in ("{", "["):
                end = balanced(page, begin)
                if end < 0 and "}" not in page[begin:] and "]" not in page[begin:]:
                    return  # nothing closes any more
                if end > 0:
                    yield page[begin:end]
                    at = end

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, text) for i, page in enumerate(batch.column(1).to_pylist()) for k, text in enumerate(found(page or ""))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["id", "place", "json"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"id {kind}, place long, json string")


def linked_data(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, place, json): the contents of a page's scripts of linked data, in order."""
    found = F.regexp_extract_all(html_col, F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script"""), F.lit(1))
    return pages.select(F.col(id_col).alias("id"), F.posexplode(found).alias("place", "json")).withColumn("place", F.col("place").cast("long"))


def path(value: Column, *ways: str) -> Column:
    """The text at the first of several paths of a VARIANT that holds something: not null, empty, 0 or false."""
    found = [F.try_variant_get(value, way, "string") for way in ways]
    return tx.first_text(*(tx.stripped(F.when(~x.isin("0", "false"), x)) for x in found))


def threads(state: DataFrame, base: str, platform: str = "tieba", lists: Sequence[str] = ("$.thread_list.thread_list", "$.thread_list", "$"), limit: int = 50) -> DataFrame:
    """(id, post_id, title, content, author, url, place): posts of a page's state (id, place, json), first `limit` of each page.

    A state holds its list itself, or at one of `lists`. An entry without an id or a title is no
    post; one whose id came before on its page is left out. An author is a name or an object with one.
    """
    v = F.try_parse_json("json")
    many = F.coalesce(*(F.try_variant_get(v, way, "array<variant>") for way in lists))
    item = state.select("id", F.col("place").alias("s"), F.posexplode(many).alias("i", "v"))
    tid = path(F.col("v"), "$.thread_id", "$.tid", "$.id")
    title = path(F.col("v"), "$.title", "$.thread_name")
    own = item.select("id", "s", "i", tid.alias("tid"), title.alias("title"), path(F.col("v"), "$.abstract", "$.content").alias("said"), path(F.col("v"), "$.author.name", "$.author.display_name").alias("named"), F.when(F.schema_of_variant(F.try_variant_get("v", "$.author", "variant")) == "STRING", F.try_variant_get("v", "$.author", "string")).alias("plain"))
    own = own.where("tid <> '' and title <> ''")
    first = own.groupBy("id", "tid").agg(F.min_by(F.struct("s", "i", "title", "said", "named", "plain"), F.struct("s", "i")).alias("r")).select("id", "tid", "r.*")
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("s", "i"))).where(F.col("place") <= limit)
    post = F.concat_ws("_", F.lit(platform), "tid")
    return first.select("id", post.alias("post_id"), "title", tx.first_text(F.col("said"), F.concat(F.lit("贴吧主题帖 tid="), "tid")).alias("content"), tx.first_text(F.col("named"), F.col("plain")).alias("author"), F.concat(F.lit(f"{base}/p/"), "tid").alias("url"), F.col("place").cast("long").alias("place"))


def resolved(base: Column, href: Column) -> Column:
    """A link as a whole URL: against the page's, by scheme, host, root, query or folder; dots in its path are walked."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    whole = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href == "", base)
        .otherwise(F.concat(folder, href))
    )
    tail = F.regexp_extract(whole, r"([?#].*)$", 1)
    start, steps = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    walked = F.aggregate(F.split(steps, "/"), F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    ends = F.when(steps.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise("")
    dotted = F.concat(start, F.lit("/"), F.array_join(walked, "/"), F.when(F.size(walked) > 0, ends).otherwise(""), tail)
    return F.when(steps.rlike(r"(^|/)\.\.?(/|$)"), dotted).otherwise(whole)


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1) -> DataFrame:
    """(id, url, title, place): a page's links with their texts, each URL once in order of the page; those with fewer than `least` characters of text are left out."""
    pattern = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>(.*?)</a\s*>"""
    part = lambda k: F.regexp_extract_all(html_col, F.lit(pattern), F.lit(k))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("page"), F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("t"))).alias("at", "x"))
    text = tx.clean_text(tx.strip_tags(F.col("x.t")))
    own = own.select("id", "at", resolved(F.col("page"), tx.stripped(tx.first_text(F.col("x.a"), F.col("x.b")))).alias("url"), text.alias("title")).where(F.length("title") >= least)
    first = own.groupBy("id", "url").agg(F.min_by("title", "at").alias("title"), F.min("at").alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("at")).cast("long")).drop("at")


def posts_among(found: DataFrame, platform: str = "tieba", pattern: str = r"/p/([0-9]+)", limit: int = 50) -> DataFrame:
    """(id, post_id, title, url, place): links (id, url, title, place) to posts, each post once, the first `limit` of each page."""
    own = found.withColumn("tid", F.regexp_extract("url", pattern, 1)).where("tid <> ''")
    first = own.groupBy("id", "tid").agg(F.min_by(F.struct("title", "url", "place"), "place").alias("r"))
    return first.select("id", F.concat_ws("_", F.lit(platform), "tid").alias("post_id"), "r.title", "r.url", F.row_number().over(Window.partitionBy("id").orderBy("r.place")).cast("long").alias("place")).where(F.col("place") <= limit)


def note_cards(answers: DataFrame, wanted: int = 9, cards: str = "$.cards", group: str = "$.card_group", kind: str = "$.card_type") -> DataFrame:
    """(id, place, card): of search answers (id, body), the cards of the wanted kind as VARIANT, in order: a card ahead of those in its group.

    Cards without a kind, and what is no object, are passed over; a card of another kind may hold a group.
    """
    outer = answers.select("id", F.posexplode(F.try_variant_get(F.try_parse_json("body"), cards, "array<variant>")).alias("i", "card"))
    inner = outer.select("id", "i", F.posexplode(F.try_variant_get("card", group, "array<variant>")).alias("k", "card"))
    both = outer.select("id", "i", F.lit(-1).alias("k"), "card").unionByName(inner).where(F.try_variant_get("card", kind, "int") == wanted)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("i", "k")).cast("long")).select("id", "place", "card")
