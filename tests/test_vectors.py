"""Similar pairs and stored indexes against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.operators import curation, vectors
from hearsay.sources import vector_index as vi


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(seed, n=300, kinds=12, width=16):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(kinds, width))
    return unit(middle[rng.integers(kinds, size=n)] + 0.25 * rng.normal(size=(n, width)))


def frame(spark, x, first=0, key="key", vec="centroid"):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], f"{key} long, {vec} array<double>")


@pytest.mark.parametrize("threshold", [0.95, 0.8, 0.2, -0.5])
def test_similar_pairs_are_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(vectors, "LANE", 20)
    x, y = clustered(1), clustered(2, 120)
    left, right = frame(spark, x), frame(spark, y, 1000)
    got = {(r.a, r.b) for r in vectors.similar_pairs(left, right, threshold).collect()}
    s = x @ y.T
    assert {(i, 1000 + j) for i, j in zip(*np.nonzero(s >= threshold + 1e-9))} <= got <= {(i, 1000 + j) for i, j in zip(*np.nonzero(s >= threshold - 1e-9))}
    rows = vectors.similar_pairs(left, None, threshold).collect()
    s = np.triu(x @ x.T, 1) - 2 * np.tril(np.ones((300, 300)))
    assert len(rows) == len({(r.a, r.b) for r in rows}) == (s >= threshold).sum()


def test_candidates_are_few(spark):
    x = clustered(3, 600, 30)
    n = vectors.candidate_pairs(frame(spark, x), None, 0.9).count()
    assert (np.triu(x @ x.T, 1) >= 0.9).sum() <= n < 600 * 599 / 2 / 4


def test_edges_of_pairs(spark):
    x = frame(spark, np.array([[1.0, 0], [1, 0], [0, 1], [0, 0]]))
    assert {(r.a, r.b) for r in vectors.similar_pairs(x, None, 0.5).collect()} == {(0, 1)}
    assert vectors.similar_pairs(x.limit(0), x, 0.5).count() == 0 and vectors.similar_pairs(x, x.limit(0), 0.5).count() == 0
    same = frame(spark, np.ones((50, 4)) / 2)
    assert vectors.similar_pairs(same, None, 0.99).count() == 50 * 49 / 2
    pairs = curation.grey_pairs(frame(spark, clustered(4, 40)), 0.7, 0.86).collect()
    assert all(0.7 <= p.similarity < 0.86 for p in pairs) and [p.similarity for p in pairs] == sorted((p.similarity for p in pairs), reverse=True)


def test_an_index_answers_like_a_scan(spark, tmp_path):
    x = np.vstack([clustered(5, 900, 40), np.zeros((1, 16)), 3 * clustered(6, 9, 3)])  # lengths other than one, too
    path = str(tmp_path / "index")
    all_rows = frame(spark, x, 0, "vec_id", "embedding")
    vi.build(all_rows.where("vec_id % 4 <> 0"), path)
    asked = clustered(5, 20, 40)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query long, vec array<double>")

    def held(ids, version):
        got = vi.search(queries, path, 10, version=version).collect()
        for q in range(len(asked)):
            want = sorted(((-round(float(x[i] @ asked[q]), 9), i) for i in ids))[:10]
            assert [(r.id, r.rank) for r in sorted((r for r in got if r["query"] == q), key=lambda r: r.rank)] == [(i, k) for k, (_, i) in enumerate(want, 1)]

    held([i for i in range(len(x)) if i % 4], 0)
    vi.extend(all_rows, path, 1)
    held(range(len(x)), 1)
    vi.extend(all_rows, path, 2)  # nothing new
    held(range(len(x)), 2)
    looked = vi.looked_into(queries, path, 10, 2).collect()
    assert len(looked) == 20 and all(r.n < r.cells / 3 for r in looked)


def test_edges_of_an_index(spark, tmp_path):
    path = str(tmp_path / "index")
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    vi.build(few, path)
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0])], "query string, vec array<double>")
    got = {(r["query"], r.id, r.rank) for r in vi.search(queries, path, 5).collect()}
    assert got == {("a", 1, 1), ("a", 3, 2), ("b", 3, 1), ("b", 1, 2)}
    assert {(r["query"], r.id) for r in vi.search(queries, path, 5, 0.5).collect()} == {("a", 1)}


def test_copies_of_a_vector_give_k_rows_a_block(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0], None, 0)], "query long, vec array<double>, least double, cell int")
    held = spark.range(500).selectExpr("id", "array(1.0D, 0.0D) as other", "0 as cell")
    rows = vi._met(asked, held, 3, -1.0).collect()
    assert sorted((r.id, r.similarity) for r in rows) == [(0, 1.0), (1, 1.0), (2, 1.0)]
