"""Queries on small tables with odd rows, against their SQL."""

import duckdb
import pytest

from hearsay import queries, read_queries  # noqa: F401
from tests.check import assert_same


@pytest.fixture
def same_on(spark, tmp_path):
    def check(query, name, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        with duckdb.connect() as con:
            con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
            assert_same(queries.QUERIES[query](spark, str(tmp_path)), con.sql(queries.ORACLE_SQL[query]))

    return check


def test_equal_texts_without_an_id_are_all_ranked(same_on):
    # 35 and 70 share a platform, a missing id and a text, so one hash, and have an even and an odd number of likes
    docs = [(i, "the same text", "en", "web", 10 + i) for i in (35, 70, 105, 140)]
    docs += [(5 * i, f"text {i}", "en", "web", i % 997) for i in range(1, 2001)]
    same_on("d02_processed_and_ranked", "documents", "doc_id long, text string, lang string, source string, n_chars int", docs)


def test_percentile_just_below_half_a_hundredth(same_on):
    rows = [(i, "a", float(i)) for i in range(2000)] + [(2000 + i, "b", float(i // 2)) for i in range(2000)]
    same_on("w01_midrank_percentile", "events", "event_id long, event_type string, value double", rows)


def test_quote_is_cut_from_what_a_page_shows(same_on):
    heads = ["Die&amp;&amp;&amp; der&amp;&amp;&amp; teberheit", "plain heading of a page that goes on", "a &lt;b&gt; c", ""]
    pages = [(9 * i + 2, "https://a.example/x", f"<html><h1>{h}</h1><p>text</p></html>") for i, h in enumerate(heads) for i in range(4 * i, 4 * i + 4)]
    same_on("z28_c41_fetch_verdict", "pages", "page_id long, url string, html string", pages)
