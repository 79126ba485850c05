"""Clustering and similarity of posts by unit vectors and time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, MERGE, ALIGN, SPAN_DAYS, TIE = 0.65, 0.86, 0.75, 90.0, 1e-9
#: Rows whose products with all centres are held at once.
LOOK = 64


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double, summed from the first element on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def top_by_cosine(vectors: DataFrame, query: list[float], k: int = 30, threshold: float = 0.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k ids most similar to a query vector; of those, the ones below the threshold are dropped."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(id_col, F.round(dot(F.col(vec_col), q), 9).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k).where(F.col("similarity") >= threshold)


def centroids(members: DataFrame, key: str, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(key, n, centroid): the normalised sum of each group's vectors, summed position by position in parallel."""
    cell = members.select(key, F.posexplode(vec_col).alias("pos", "x")).groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    out = cell.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return out.select(key, "n", normalise(F.col("v")).alias("centroid"))


def match_tier(similarity: Column, accept: float = 0.65, judge: float = 0.45) -> Column:
    return F.when(similarity >= accept, "accept").when(similarity >= judge, "judge").otherwise("reject")


def _fits(lo: np.ndarray, hi: np.ndarray, low: float, high: float, days: float) -> np.ndarray:
    """Whether the spans of both are short enough; unknown times (lo inf, hi -inf) don't count, and days <= 0 asks for nothing."""
    first, last = np.minimum(lo, low), np.maximum(hi, high)
    with np.errstate(invalid="ignore"):
        return (days <= 0) | ~np.isfinite(first) | ~np.isfinite(last) | (last - first <= days)


class _Clusters:
    """Clusters of a block: sums and centres of their vectors, spans and names. Takes memory in proportion to their number."""

    def __init__(self, width: int, days: float) -> None:
        self.n, self.days = 0, days
        self.total, self.centre = np.zeros((64, width)), np.zeros((64, width))
        self.lo, self.hi, self.live = np.full(64, np.inf), np.full(64, -np.inf), np.zeros(64, bool)
        self.members: list[list[int]] = []

    def add(self) -> int:
        if self.n == len(self.lo):
            for name in ("total", "centre", "lo", "hi", "live"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
            self.lo[self.n :], self.hi[self.n :] = np.inf, -np.inf
        self.live[self.n] = True
        self.members.append([])
        self.n += 1
        return self.n - 1

    def put(self, c: int, total: np.ndarray, lo: float, hi: float) -> None:
        self.total[c] = total
        self.centre[c] = total / max(np.sqrt((total * total).sum()), 1e-300)
        self.lo[c], self.hi[c] = min(self.lo[c], lo), max(self.hi[c], hi)

    def near(self, rough: np.ndarray, v: np.ndarray, lo: float, hi: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The live clusters whose centre is at least `least` near to v and whose span with (lo, hi) fits, and how near they are.

        rough has the products with all centres to some ten decimals; what comes out is worked out row by row, so it doesn't depend on how rough was.
        """
        at = np.flatnonzero(rough >= least - TIE)
        at = at[self.live[at]]
        at = at[_fits(self.lo[at], self.hi[at], lo, hi, self.days)]
        value = (self.centre[at] * v).sum(axis=1)
        return at[value >= least], value[value >= least]

    def beside(self, c: int, least: float, rough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The other clusters that c may be merged with, and how near they are."""
        v = self.centre[c]
        at, value = self.near(self.centre[: self.n] @ v if rough is None else rough, v, self.lo[c], self.hi[c], least)
        return at[at != c], value[at != c]


def _join(own: _Clusters, vec: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float) -> None:
    """Each vector in turn joins the nearest cluster that it fits, or begins one."""
    for start in range(0, len(vec), LOOK):
        part = vec[start : start + LOOK]
        known = own.n
        products = part @ own.centre[:known].T
        changed: dict[int, None] = {}
        for k, v in enumerate(part):
            rough = np.concatenate([products[k], np.zeros(own.n - known)])
            if changed:
                late = np.fromiter(changed, int, len(changed))
                rough[late] = own.centre[late] @ v
            i = start + k
            at, value = own.near(rough, v, lo[i], hi[i], threshold)
            c = int(at[value.argmax()]) if len(at) else own.add()
            own.members[c].append(i)
            own.put(c, own.total[c] + v, lo[i], hi[i])
            changed[c] = None


def _merge(own: _Clusters, vec: np.ndarray, ids: np.ndarray, merge: float) -> np.ndarray:
    """Merge the nearest pair that fits as long as there is one; the clusters' names. Of each cluster only its nearest other one is kept."""
    name = np.array([min(ids[m]) for m in own.members], dtype=ids.dtype)
    best, other = np.full(own.n, -np.inf), np.full(own.n, -1)

    def found(c: int, at: np.ndarray, value: np.ndarray) -> None:
        best[c], other[c] = (value.max(), at[value.argmax()]) if len(at) else (-np.inf, -1)

    for start in range(0, own.n, LOOK):
        products = own.centre[start : start + LOOK] @ own.centre[: own.n].T
        for k in np.flatnonzero((products >= merge - TIE).sum(axis=1) > 0):
            found(start + k, *own.beside(start + k, merge, products[k]))
    while len(best) and np.isfinite(top := best.max()):
        pairs = ((c, d) for c in np.flatnonzero(best >= top - TIE) for d in own.beside(c, max(merge, top - TIE))[0])
        a, b = sorted(min(pairs, key=lambda p: sorted((name[p[0]], name[p[1]]))))
        own.members[a] += own.members[b]
        rows = np.array(own.members[a])
        own.put(a, vec[rows[np.argsort(ids[rows], kind="stable")]].sum(axis=0), own.lo[b], own.hi[b])
        name[a] = min(name[a], name[b])
        own.live[b], best[b] = False, -np.inf
        lost = np.flatnonzero(np.isin(other, (a, b)) & own.live[: own.n])
        other[b] = -1
        for c in {a, *lost.tolist()}:
            at, value = own.beside(c, merge)
            found(c, at, value)
            if c == a:
                more = value > best[at]
                best[at[more]], other[at[more]] = value[more], a
    return name


def greedy_clusters(posts: DataFrame, block: str, *, threshold: float = THRESHOLD, merge: float = MERGE, span_days: float = SPAN_DAYS) -> DataFrame:
    """(block, id, cluster): clusters of posts (block, id, rank_key, at_days, vector) within blocks of posts that can meet.

    Posts come by rank_key, then id, greatest first; each joins the most similar cluster whose
    centroid is near enough and whose span with it is short enough, trying the next best else.
    Then the most similar pair of clusters is merged as long as one is near enough; among pairs
    within 1e-9 the smallest ids decide. The order of rows has no influence. The procedure is
    sequential, so it runs by block, a topic or a stretch of time that the span rule separates.
    A block takes memory in proportion to its posts, however many clusters are near each other, and
    a time of posts by clusters. A cluster is named by its smallest id.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank_key", "id"], ascending=False)
        vec = np.array(pdf.pop("vector").tolist(), float)
        vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-300)
        at, ids = pdf["at_days"].to_numpy(float), pdf["id"].to_numpy()
        own = _Clusters(vec.shape[1], span_days)
        _join(own, vec, np.where(np.isnan(at), np.inf, at), np.where(np.isnan(at), -np.inf, at), threshold)
        name = _merge(own, vec, ids, merge)
        cluster = np.empty(len(ids), dtype=ids.dtype)
        for c in np.flatnonzero(own.live[: own.n]):
            cluster[own.members[c]] = name[c]
        return pd.DataFrame({block: pdf[block].iloc[0], "id": ids, "cluster": cluster})

    kind = posts.schema[block].dataType.simpleString()
    return posts.select(block, "id", "rank_key", "at_days", "vector").groupBy(block).applyInPandas(run, f"{block} {kind}, id long, cluster long")
