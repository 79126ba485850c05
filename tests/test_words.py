"""Many words against a search for each, and segmentation against all ways to split."""

import itertools
import math
import random
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearsay import queries
from hearsay.functions import text as tx
from hearsay.operators import words as wd
from tests.check import assert_same


@pytest.mark.parametrize("block", [10**6, 300])
def test_thousands_of_words_like_word_hits(spark, monkeypatch, block):
    monkeypatch.setattr(wd, "BLOCK", block)
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab热水") for _ in range(rng.randrange(1, 9))) for _ in range(2000)})
    texts = [(i, "".join(rng.choice("ab热水 ") for _ in range(rng.randrange(200)))) for i in range(60)] + [(100, None), (101, ""), (102, "aaaa")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    rows = wd.matched(docs, spark.createDataFrame([(w,) for w in [*words, "", words[0]]], "word string"), "id", "text").collect()
    got = {}
    for r in rows:
        assert (r.id, r.word) not in got
        got[r.id, r.word] = (r.n, r.first_at)
    for i, text in texts:
        for w in words:
            at = [k for k in range(len(text or "")) if text.startswith(w, k)]
            assert got.get((i, w)) == ((len(at), at[0]) if at else None)
    few = words[:40]
    hits = {r.id: r.h for r in docs.select("id", F.array_sort(tx.word_hits(F.coalesce("text", F.lit("")), few)).alias("h")).collect()}
    assert all(hits[i] == sorted(w for w in few if (i, w) in got) for i, _ in texts)


def test_answers(spark):
    docs = spark.createDataFrame([(1, "作息调整了宿舍"), (2, "宿舍作息"), (3, "none")], "id long, text string")
    words = spark.createDataFrame([(w,) for w in ("作息", "作息调整", "宿舍", "食堂", "x" * 65)], "word string")
    got = {r.id: tuple(r)[1:] for r in wd.answers(wd.matched(docs, words, "id", "text")).collect()}
    assert got == {1: (3, "作息调整", "作息调整"), 2: (2, "作息", "宿舍")}
    assert wd.matched(docs, words.limit(0), "id", "text").count() == 0 and wd.matched(docs.limit(0), words, "id", "text").count() == 0


def places(words, text):
    at = {w: [k for k in range(len(text)) if text.startswith(w, k)] for w in words}
    return {w: [len(own), own[0]] for w, own in at.items() if own}


@pytest.mark.parametrize("block", [10**6, 30])
def test_words_of_any_length(spark, monkeypatch, block):
    monkeypatch.setattr(wd, "BLOCK", block)
    monkeypatch.setattr(wd, "HELD", 500)
    rng = random.Random(5)
    stem = "".join(rng.choice("ab热😀") for _ in range(3000))
    words = {stem[a : a + n] for a in (0, 7, 900) for n in (63, 64, 65, 66, 128, 129, 700, 2000)} | {stem[:100] + "c" * n for n in range(5)} | {"a" * n for n in range(60, 90)} | {"b" * 2500, stem + "c"}
    texts = [stem, stem[1:] + stem, stem[900:] + " " + stem[:107] + "cc", "a" * 200, "a" * 70 + "b" * 2501, stem[:64], "a" * 64, "", None] + [stem[i : i + 80] + "c" * 3 for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    rows = wd.matched(docs, spark.createDataFrame([(w,) for w in words], "word string"), "id", "text").collect()
    got = {(r.id, r.word): [r.n, r.first_at] for r in rows}
    assert len(got) == len(rows)
    assert got == {(i, w): found for i, text in enumerate(texts) for w, found in places(words, text or "").items()}


def test_long_words_of_items_like_the_sql(spark, tmp_path):
    item = "die一鿿" * 60
    items = [(1, f"Say {item} and {item[:65]} or {item[:64]}, x{item}."), (2, "=" * 300 + " " + "=" * 65 + " the"), (3, None)]
    docs = [(1, f"the {item} the"), (2, f"{item[:70]} {'=' * 299}"), (3, f"x{item}.{item}"), (4, "=" * 64), (5, "=" * 400), (6, item[:64].upper()), (7, ""), (8, None)]
    for name, schema, rows in (("benchmark", "item_id long, text string", items), ("documents", "doc_id long, text string", docs)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    with duckdb.connect() as con:
        for name in ("benchmark", "documents"):
            con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        query = "j17_c14_z31_many_words"
        assert_same(queries.QUERIES[query](spark, str(tmp_path)), con.sql(queries.ORACLE_SQL[query]))


def test_long_words_at_random():
    rng = random.Random(4)
    for _ in range(300):
        letters = rng.choice(["a", "ab", "ab热"])
        stem = rng.choices(letters, k=3) + rng.choices(letters, k=wd.HEAD - 3)
        words = {"".join(stem + rng.choices(letters, k=rng.randrange(12))) for _ in range(20)} | {"".join(rng.choices(letters, k=wd.HEAD + rng.randrange(4))) for _ in range(20)} | {rng.choice(letters) * rng.randrange(1, 20)}
        text = "".join(rng.choice([rng.choice(letters + "z"), *words]) for _ in range(12))
        assert wd.ManyWords(words).found(text) == places(words, text)


def test_a_run_takes_a_time_in_proportion_to_it_with_thousands_of_long_words():
    finder = wd.ManyWords("a" * n for n in range(65, 3000))
    began = time.process_time()
    seen = finder.found("a" * 200_000 + "z" + "a" * 100)
    # every word at every place took 600 million steps
    assert time.process_time() - began < 5
    assert seen["a" * 65] == [200_000 - 64 + 36, 0] and seen["a" * 2999] == [200_000 - 2998, 0]


def split_by_all_ways(counts, run):
    total = sum(counts.values())
    best = None
    for marks in itertools.product([False, True], repeat=len(run) - 1):
        cut = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
        words = [run[a:b] for a, b in itertools.pairwise(cut)]
        if all(w in counts or len(w) == 1 for w in words):
            score = sum(math.log(counts.get(w, 1) / total) for w in words)
            if best is None or score > best + 1e-9:
                best = score
    return best


def test_segmentation_takes_the_most_probable_path():
    rng = random.Random(8)
    for _ in range(300):
        counts = {"".join(rng.choice("热水宿舍") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(12)}
        run = "".join(rng.choice("热水宿舍停") for _ in range(rng.randrange(1, 11)))
        words = wd.Segmenter(counts).cut(run)
        total = sum(counts.values())
        assert "".join(words) == run and math.isclose(sum(math.log(counts.get(w, 1) / total) for w in words), split_by_all_ways(counts, run), abs_tol=1e-9)


def test_segmented_texts(spark):
    dictionary = spark.createDataFrame([("中山大学", 50), ("中山", 30), ("大学", 90), ("大学生", 40), ("宿舍", 80), ("热水", 60), ("停", 5), ("的", 500), ("", 7), (None, 7), ("负", 0)], "word string, n long")
    docs = spark.createDataFrame([(1, "中山大学生宿舍，热水停了 wifi6 down_again"), (2, "的的宿舍"), (3, None), (4, "")], "id long, text string")
    rows = wd.segmented(docs, dictionary, "id", "text")
    got = {(r.id, r.word): r.n for r in rows.collect()}
    assert got == {(1, "中山"): 1, (1, "大学生"): 1, (1, "宿舍"): 1, (1, "热水"): 1, (1, "停"): 1, (1, "了"): 1, (1, "wifi6"): 1, (1, "down"): 1, (1, "again"): 1, (2, "的"): 2, (2, "宿舍"): 1}
    top = wd.word_frequencies(rows, spark.createDataFrame([("的",)], "word string"), 2).collect()
    assert [(r.word, r.n) for r in top] == [("宿舍", 2), ("again", 1)]


def test_a_long_text_takes_a_time_in_proportion():
    cutter = wd.Segmenter({"热水": 5, "水": 2, "热": 1})
    assert len(cutter.words("热水" * 100_000)) == 100_000


def test_texts_are_taken_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(wd, "HELD", 10)
    batch = pa.record_batch([pa.array(range(7)), pa.array(["aaaa", None, "热水", "b" * 50, "", "c", "d"])], ["id", "text"])
    assert list(wd._held(batch)) == [(0, ["aaaa", None, "热水"]), (3, ["b" * 50]), (4, ["", "c", "d"])]
    assert list(wd._held(batch.slice(0, 0))) == []


def test_a_run_takes_a_time_by_its_words_not_by_the_longest_one():
    counts = {w: n for n, w in enumerate(("a", "ab", "ba", "x" * 64), 1)}
    cutter = wd.Segmenter(counts, "a-z")
    began = time.process_time()
    assert "".join(cutter.cut("ab" * 300_000)) == "ab" * 300_000
    # 64 pieces at each place took several times as long
    assert time.process_time() - began < 3
