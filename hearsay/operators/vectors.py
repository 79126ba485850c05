"""Vectors by similarity: pairs above a threshold, cells around centres, and their exact bounds."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators.cluster import dot

#: Most centres, which go through the driver and a broadcast: 256 of 1,000 components are 2 MB.
CENTRES = 256
#: Rows of a cell that are compared in one task.
LANE = 2_000


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as doubles; lists of another length, and nulls, are zeros."""
    out = np.zeros((len(column), width))
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if width and (size == width).all() and not column.null_count:
        return np.nan_to_num(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width))
    for i in np.flatnonzero(size == width):
        out[i] = [0.0 if x is None else float(x) for x in column[int(i)].as_py()]
    return np.nan_to_num(out)


def some_centres(vectors: DataFrame, id_col: str, vec_col: str, n: int) -> np.ndarray:
    """n of the vectors, chosen by a hash of their ids."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(vec_col).orderBy(F.xxhash64(id_col), id_col).limit(min(n, CENTRES)).collect()
    width = len(rows[0][0]) if rows else 0
    return np.unique(np.array([r[0] for r in rows if len(r[0]) == width], float).reshape(-1, width), axis=0) if rows else np.zeros((0, 0))


def with_cells(vectors: DataFrame, key: str, vec_col: str, centres: np.ndarray, reach: float | None = None) -> DataFrame:
    """(key, vec, cell, away): each vector with its nearest centre and the distance to it.

    With reach, a row for every cell that may hold a vector within that distance: the cell's
    members are nearer to its centre than to the vector's own one, so they are at least
    (d^2 - own^2) / 2g away, d and own being the distances to both centres, g theirs.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        gap = np.sqrt(np.maximum(((centres[:, None, :] - centres[None]) ** 2).sum(axis=2), 0.0))
        for batch in batches:
            x = matrix(batch.column(1), centres.shape[1])
            d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0))
            own = d.argmin(axis=1) if len(x) else np.zeros(0, int)
            if reach is None:
                row, cell = np.arange(len(x)), own
            else:
                mine = d[np.arange(len(x)), own][:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(gap[own] > 0, (d**2 - mine**2) / (2 * gap[own]), 0.0)
                row, cell = np.nonzero(least <= reach + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(d[row, cell])], ["key", "vec", "cell", "away"])

    kinds = dict(vectors.dtypes)
    return vectors.select(F.col(key).alias("key"), F.col(vec_col).alias("vec")).mapInArrow(run, f"key {kinds[key]}, vec {kinds[vec_col]}, cell int, away double")


def candidate_pairs(left: DataFrame, right: DataFrame | None, threshold: float, key: str = "key", vec_col: str = "centroid", centres: int | None = None) -> DataFrame:
    """(a, x, b, y): pairs of vectors that may have a dot product of at least threshold, every such pair among them, each once.

    Vectors have length one, so the pairs are those within r = sqrt(2 - 2 * threshold). A left
    vector is in the cell of its nearest centre; a right one goes to each cell that its distance
    allows, and there meets those whose distance to the centre differs from its own by r at most
    (triangle inequality). A cell of many left vectors is dealt to lanes, each of which gets the
    right ones. Without right, pairs are those of left with itself, a < b.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    n = left.count()
    middle = some_centres(left, key, vec_col, centres or max(1, math.isqrt(n)))
    if not len(middle):
        x = left.select(F.col(key).alias("a"), F.col(vec_col).alias("x")).limit(0)
        return x.join((left if right is None else right).select(F.col(key).alias("b"), F.col(vec_col).alias("y")), F.lit(False))
    own = with_cells(left, key, vec_col, middle)
    lanes = own.groupBy("cell").agg(F.expr(f"1 + count(*) div {LANE}").alias("lanes"))
    # a row for each centre
    lanes = F.broadcast(lanes)
    x = own.join(lanes, "cell").select("cell", F.expr("pmod(xxhash64(key), lanes)").alias("lane"), F.col("key").alias("a"), F.col("vec").alias("x"), F.col("away").alias("x_away"))
    y = with_cells(left if right is None else right, key, vec_col, middle, reach).join(lanes, "cell")
    y = y.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane"), F.col("key").alias("b"), F.col("vec").alias("y"), F.col("away").alias("y_away"))
    near = F.abs(F.col("x_away") - F.col("y_away")) <= reach + 1e-6
    met = x.join(y, ["cell", "lane"]).where(near)
    return (met.where("a < b") if right is None else met).select("a", "x", "b", "y")


def similar_pairs(left: DataFrame, right: DataFrame | None, threshold: float, key: str = "key", vec_col: str = "centroid", centres: int | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs with a dot product of at least threshold; see candidate_pairs."""
    met = candidate_pairs(left, right, threshold, key, vec_col, centres)
    return met.select("a", "b", dot(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= threshold)
