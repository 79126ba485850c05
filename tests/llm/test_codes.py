"""Vector codes against a plain version, and edges."""

import math

import numpy as np
import pytest

from hearsay.llm import codes, queries
from tests.check import assert_same

SCHEMA = "vec_id long, embedding array<double>, label string, v long, code string, n long"


def table(spark, rows):
    """(vec_id, embedding, label) with columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def plain(rows, parts, entries, rounds):
    """Codes, errors and codebooks by loops over whole numbers."""
    own = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows]
    w = len(own[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in own]
    first = sorted(range(len(own)), key=lambda k: (own[k][0] is None, own[k][0] or 0, own[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            to = [near(x[p], book)[1] for x in cut]
            for j in range(len(book)):
                members = [x[p] for x, k in zip(cut, to, strict=True) if k == j]
                if members:
                    book[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    return sorted((str(i), "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for (i, _, _), f in zip(own, found, strict=True)), books


@pytest.mark.parametrize("entries", [4, 16])
def test_against_loops(spark, entries):
    rng = np.random.default_rng(entries)
    rows = [(int(i), [float(x) for x in rng.choice([-0.7, -0.3, 0.001, 0.25, 0.9], 8)], "ab"[i % 2]) for i in rng.permutation(90)] + [(7, [0.5] * 8, None), (None, [0.25] * 8, None)]
    coded, book = codes.compress(table(spark, rows).repartition(3), entries=entries)
    want, books = plain(rows, 4, entries, 4)
    assert sorted((str(r.vec_id), r.code, r.error) for r in coded.collect()) == want
    assert book.tolist() == books
    known = codes.label_errors(coded).collect()
    total = {}
    for r in known:
        total[r.label] = total.get(r.label, 0) + r.error
    assert all(r.label_error == total[r.label] for r in known) and len(known) == len(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1] * 4, "a"), (1, [0.1] * 4, "a"), (2, None, "a"), (3, [0.1, None, 0.1, 0.1], "a"), (4, [nan, 0.0, 0.0, 0.0], "a"), (5, [0.0, -inf, 0.0, 0.0], "a"), (6, [], "a"), (7, [0.1] * 3, "a"), (8, [-1e300, 1e300, 1e9, -0.0004], None)]
    coded, book = codes.compress(table(spark, rows))
    got = {r.vec_id: r for r in coded.collect()}
    assert sorted(got) == [1, 8] and coded.count() == 3
    assert book.shape == (4, 3, 1) and got[8].error == 0 and got[1].code == "00000000"
    assert book[0, 2, 0] == -(2**29) and book[3, 2, 0] == -1
    coded, book = codes.compress(table(spark, []))
    assert coded.count() == 0 and codes.codebook_digest(book) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    coded, book = codes.compress(table(spark, [(1, [1.0] * 5, "a"), (2, [0.5] * 5, "a")]))
    assert book.shape == (4, 2, 2) and book[3].tolist() == [[0, 0], [0, 0]] and {r.error for r in coded.collect()} == {0}
    coded, _ = codes.compress(table(spark, [(1, [], "a"), (2, [], "a")]))
    assert {(r.code, r.error) for r in coded.collect()} == {("00000000", 0)}


def test_one_hot_vector_and_label(spark):
    rows = [(i, [0.25, -0.5, 0.75, 0.1] if i % 3 else [i / 1000.0, 0.1, 0.2, 0.3], "same" if i % 3 else f"l{i}") for i in range(900)]
    coded, _ = codes.compress(table(spark, rows))
    out = codes.label_errors(coded)
    assert out.count() == 900 and out.where("label = 'same'").select("label_error").distinct().count() == 1


def test_same_rows_as_sql(spark, sf, duck):
    assert_same(queries.QUERIES["op12_vector_codes"](spark, sf), duck.sql(queries.ORACLE_SQL["op12_vector_codes"]))
