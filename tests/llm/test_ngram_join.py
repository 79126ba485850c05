"""The n-gram join against all pairs, and edges."""

import random

import pytest

from hearsay.llm import ngram_join, queries
from tests.check import assert_same
from tests.llm.test_llm import EDGE, documents, shingle_set


def by_all_pairs(rows, percent=80):
    """The smallest id that each document reaches."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    own = {i: i for i in ids}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for x in ids:
        for y in ids:
            shared = len(sets[x] & sets[y])
            if x < y and shared and 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                a, b = sorted((root(x), root(y)))
                own[b] = a
    return {i: root(i) for i in ids}


def family(rng, first, size, length, edits):
    base = [f"{first}w{i}" for i in range(length)]
    out = []
    for k in range(size):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"]
        out.append((first + k, " ".join(words)))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [r for k in range(8) for r in family(rng, 100 * k, 14, rng.choice([8, 12, 30, 60, 200]), 4)]
    rows += [(1000 + k, " ".join(f"own{k}x{i}" for i in range(rng.randrange(5, 40))) + " " + passage) for k in range(40)]
    rows += [(2000 + k, " ".join(f"t{i}" for i in range(k))) for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(documents(spark, rows)).collect()}
    want = by_all_pairs(rows)
    assert got == {i: (len(shingle_set(t)), want[i]) for i, t in rows}
    assert len(set(want.values())) > 40


def test_pairs_at_exactly_the_threshold(spark):
    # 90 shingles each, 80 of all 100 shared; one word more makes it 80 of 101
    rows = []
    for k in range(30):
        base = [f"{k}b{i}" for i in range(84)]
        rows += [(10 * k, " ".join(base + [f"{k}x{i}" for i in range(10)])), (10 * k + 1, " ".join(base + [f"{k}y{i}" for i in range(10)])), (10 * k + 2, " ".join(base + [f"{k}z{i}" for i in range(11)]))]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(documents(spark, rows)).collect()}
    for k in range(30):
        assert [got[10 * k + j] for j in (0, 1, 2)] == [10 * k, 10 * k, 10 * k + 2]


@pytest.mark.parametrize("percent", [60, 95])
def test_other_thresholds(spark, percent):
    rng = random.Random(percent)
    rows = [r for k in range(4) for r in family(rng, 100 * k, 12, 40, 5)]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(documents(spark, rows), percent=percent).collect()}
    assert got == by_all_pairs(rows, percent)


def test_edges(spark):
    out = ngram_join.similar_documents(documents(spark, EDGE)).collect()
    assert len(out) == len(EDGE)
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 4, 6, 6, 6]
    assert [got[i].n_shingles for i in (1, 2, 3, 4, 9)] == [0, 0, 0, 1, 1]
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert ngram_join.similar_documents(documents(spark, [])).count() == 0


def test_prefixes_are_necessary(spark):
    rng = random.Random(9)
    rows = family(rng, 0, 40, 50, 6)
    sets = {i: shingle_set(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    met = {(r.a, r.b) for r in ngram_join._meeting(spark.createDataFrame(pairs, "a long, b long"), documents(spark, rows).select("doc_id", "text"), 5, 80).collect()}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            assert (a, b) in met
    assert len(met) < len(pairs)


def test_same_rows_as_sql(spark, sf, duck):
    assert_same(queries.QUERIES["op11_ngram_join"](spark, sf), duck.sql(queries.ORACLE_SQL["op11_ngram_join"]))
