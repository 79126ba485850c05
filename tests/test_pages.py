"""Page parsers: balanced state, linked data, links against Python's own resolution, and posts among them."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from hearsay.plans import pages as pg


def frame(spark, *pages):
    return spark.createDataFrame([(i, "https://t.example/f/list?kw=x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")


def test_state_is_balanced(spark):
    deep = json.dumps({"a": {"b": ["}", "]", '"', "\\"]}, "c": [1, [2, {"d": "{"}]]})
    got = pg.state_of(frame(spark, f"<script>var s = {deep};</script>", f'x "s": {deep}, "s":[1,2] s=[3', "s = {broken ] }", None, "", "no marker", "s s = {} s", "s={" * 2000), "s").collect()
    assert {(r.id, r.place): r.json for r in got} == {(0, 0): deep, (1, 0): deep, (1, 1): "[1,2]", (6, 0): "{}"}


def test_linked_data(spark):
    got = pg.linked_data(frame(spark, '<script type="application/ld+json">{"@type":"Article"}</script><script>x</script><SCRIPT async type=\'application/ld+json\'>\n[1]</SCRIPT >', None)).collect()
    assert [(r.id, r.place, r.json.strip()) for r in got] == [(0, 0, '{"@type":"Article"}'), (0, 1, "[1]")]


def test_threads(spark):
    threads = [{"thread_id": 5, "thread_name": " t ", "author": "ann"}, {"id": "6", "title": "u", "content": "c", "author": {"display_name": "bob"}}, {"tid": 5, "title": "again"}, {"tid": None, "title": "x"}, {"tid": 7, "title": " "}, "junk", 4, None, {"tid": 8, "title": "v", "author": {"name": "", "display_name": "d"}}]
    state = spark.createDataFrame([(1, 0, json.dumps({"thread_list": {"thread_list": threads}})), (1, 1, json.dumps([{"tid": 9, "title": "w"}])), (2, 0, "{broken"), (3, 0, json.dumps({"thread_list": threads}))], "id long, place long, json string")
    got = {(r.id, r.place): (r.post_id, r.title, r.content, r.author, r.url) for r in pg.threads(state, "https://t", limit=3).collect()}
    assert got[1, 1] == ("tieba_5", "t", "贴吧主题帖 tid=5", "ann", "https://t/p/5") and got[1, 2] == ("tieba_6", "u", "c", "bob", "https://t/p/6") and got[1, 3][3] == "d"
    assert {k for k in got} == {(i, k) for i in (1, 3) for k in (1, 2, 3)}


@pytest.mark.parametrize("base", ["https://a.example/b/c/d;p?q#f", "http://a.example", "https://a.example/", "https://a.example/b/c/"])
def test_resolved_like_python(spark, base):
    hrefs = ["g", "./g", "g/", "/g", "//x.example/g", "?y", "g?y", "#s", "g#s", "", "..", "../", "../g", "../..", "../../g", "../../../g", "./", ".", "g/./h", "g/../h", "/./g", "/../g", "http:x", "mailto:a@b", "https://z.example/../q", "g;x=1/../y", "a:b"]
    got = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", pg.resolved(F.lit(base), F.col("h")).alias("u")).collect()
    skip = {"http:x", "https://z.example/../q"}  # Python keeps old forms of these
    for r in got:
        if r.h not in skip:
            assert r.u == urljoin(base, r.h), r.h


def test_links_and_posts(spark):
    html = """<a href="/p/11?fr=1">first  post</a><a class=x href='/p/12'><b>second</b> &amp; more</a><a href="/p/11">again</a><A HREF="https://o.example/p/13">third</A>
    <a href="/p/14"></a><a name=x>none</a><a href="next">next</a><a href="/p/12">twice</a>"""
    links = pg.links(frame(spark, html, None, ""))
    got = {r.place: (r.url, r.title) for r in links.collect()}
    assert got == {1: ("https://t.example/p/11?fr=1", "first post"), 2: ("https://t.example/p/12", "second & more"), 3: ("https://t.example/p/11", "again"), 4: ("https://o.example/p/13", "third"), 5: ("https://t.example/f/next", "next")}
    posts = sorted((r.place, r.post_id, r.title) for r in pg.posts_among(links, limit=2).collect())
    assert posts == [(1, "tieba_11", "first post"), (2, "tieba_12", "second & more")]


def test_note_cards(spark):
    cards = [{"card_type": 9, "id": "a", "card_group": [{"card_type": 9, "id": "b"}, {"card_type": 1, "id": "c"}]}, {"card_type": 11, "card_group": [{"card_type": 9, "id": "d"}, "junk"]}, {"id": "e"}, {"card_type": 9, "id": "f", "card_group": []}, None]
    rows = pg.note_cards(spark.createDataFrame([(1, json.dumps({"cards": cards})), (2, "{}"), (3, None), (4, "x")], "id long, body string"))
    got = rows.select("id", "place", F.try_variant_get("card", "$.id", "string").alias("c")).collect()
    assert sorted((r.id, r.place, r.c) for r in got) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "d"), (1, 4, "f")]
