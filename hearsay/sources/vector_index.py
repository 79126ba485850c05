"""A stored index of vectors: a table partitioned by cell, and a table of cells with centres and radii. Searches are exact."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.operators.lineage import cut
from hearsay.operators.relational import top_per_group
from hearsay.operators.vectors import matrix, some_centres, with_cells

#: Queries and stored vectors of a pair of blocks: its products are 8 MB.
ASKED, HELD = 256, 4096


def _moved(cells: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centres moved to the mean of their cells: a row for each cell and component is added up, and at most CENTRES of them come to the driver."""
    total = cells.select("cell", F.posexplode("vec").alias("at", "x")).groupBy("cell", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    out = centres.copy()
    for r in total.collect():
        out[r.cell, r["at"]] = r.x
    return out


def _written(vectors: DataFrame, id_col: str, vec_col: str, centres: np.ndarray, path: str, mode: str) -> None:
    own = with_cells(vectors.where(F.col(vec_col).isNotNull()), id_col, vec_col, centres).select(F.col("key").alias("id"), "vec", "cell", "away")
    own.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")


def _cells(spark: SparkSession, path: str, centres: np.ndarray, version: int) -> None:
    """Radii and sizes of the cells as they are stored, as version `version`."""
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    size = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    known.join(size, "cell").write.mode("overwrite").parquet(f"{path}/cells/v{version}")


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", *, cells: int | None = None, rounds: int = 2) -> None:
    """Write an index of vectors of one length (null ones are left out) to path.

    Centres begin as vectors that a hash of the id chooses, the square root of the rows but at most
    CENTRES, and move to their cells' means. Every vector is stored in the cell of its nearest
    centre, and a cell knows how far its farthest one is.
    """
    centres = some_centres(vectors, id_col, vec_col, cells or max(1, math.isqrt(vectors.count())))
    for _ in range(rounds if len(centres) else 0):
        centres = _moved(with_cells(vectors.where(F.col(vec_col).isNotNull()), id_col, vec_col, centres), centres)
    _written(vectors, id_col, vec_col, centres, path, "overwrite")
    _cells(vectors.sparkSession, path, centres, 0)


def extend(vectors: DataFrame, path: str, version: int, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Add the vectors whose ids the index at path doesn't have, to the cells that it has; `version` numbers the new table of cells."""
    spark = vectors.sparkSession
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/cells/v{version - 1}").orderBy("cell").collect()])
    at = [r.cell for r in spark.read.parquet(f"{path}/cells/v{version - 1}").orderBy("cell").select("cell").collect()]
    new = vectors.join(spark.read.parquet(f"{path}/vectors").select(F.col("id").alias(id_col)), id_col, "left_anti")
    # an emptied centre has no cell; the numbers of the others stay
    whole = np.full((max(at) + 1, centres.shape[1]), 1e9)
    whole[at] = centres
    _written(new, id_col, vec_col, whole, path, "append")
    _cells(spark, path, whole, version)


def _tried(queries: DataFrame, cells: list, k: int, bounded: bool) -> DataFrame:
    """(query, vec, cell): the cells that each query has to look into.

    A cell's vectors have a dot product of at most q.c + |q| * radius with a query. Without
    `bounded`: the cells of the greatest bounds that hold k vectors together. With it: all others
    whose bound reaches the query's column `least`, the similarity of its k-th best so far.
    """
    shared = queries.sparkSession.sparkContext.broadcast((np.array([c.cell for c in cells], np.int32), np.array([c.centre for c in cells], float), np.array([c.radius for c in cells]), np.array([c.n for c in cells])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, centre, radius, n = shared.value
        for batch in batches:
            rows, found = [], []
            for i, (vec, least) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                q = np.array(vec, float)
                most = centre @ q + np.linalg.norm(q) * radius + 1e-9
                order = np.argsort(-most, kind="stable")
                first = int(np.searchsorted(np.cumsum(n[order]), k)) + 1
                take = order[first:][most[order[first:]] >= (-np.inf if least is None else least)] if bounded else order[:first]
                rows += [i] * len(take)
                found += cell[take].tolist()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(found, pa.int32())], ["query", "vec", "least", "cell"])

    kinds = dict(queries.dtypes)
    least = F.col("least") if bounded else F.lit(None).cast("double")
    return queries.select("query", "vec", least.alias("least")).mapInArrow(run, f"query {kinds['query']}, vec {kinds['vec']}, least double, cell int")


def _packed(rows: DataFrame, key: str, size: int, *more: str) -> DataFrame:
    """(cell, keys, vecs, ...): the rows of each cell in blocks of about `size`, dealt by a hash of the key."""
    lanes = F.broadcast(rows.groupBy("cell").agg(F.expr(f"1 + count(*) div {size}").alias("lanes")))
    own = rows.join(lanes, "cell").groupBy("cell", F.expr(f"pmod(xxhash64({key}), lanes)").alias("lane"))
    own = own.agg(F.collect_list(F.struct(key, *more)).alias("r"))
    return own.select("cell", *(F.col("r")[c].alias(c) for c in (key, *more)))


def _met(tried: DataFrame, stored: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query, id, similarity): the k best of each block of stored vectors for each query that looks into its cell, where they reach the query's `least` and the threshold.

    Blocks of both meet by their cell, and a pair of blocks is one matrix product in a task.
    What it leaves is worked out once more by itself, from the first component on.
    """
    left = _packed(tried.select("query", "vec", "cell", "least"), "query", ASKED, "vec", "least")
    pairs = left.join(_packed(stored, "id", HELD, "other"), "cell").select("query", "vec", "least", "id", "other")
    kinds = dict(tried.dtypes) | dict(stored.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                query, vec, least, key, other = (batch.column(c)[n].values for c in range(5))
                width = len(vec[0])
                x, y = matrix(vec, width), matrix(other, width)
                near = x @ y.T
                low = np.maximum(np.nan_to_num(least.to_numpy(zero_copy_only=False).astype(float), nan=-np.inf, neginf=-np.inf), threshold)[:, None]
                if k < near.shape[1]:
                    # a bit less, so that all whose nine decimals may reach the k-th best's go on
                    low = np.maximum(low, -np.partition(-near, k - 1, axis=1)[:, k - 1 : k])
                place = pc.rank(key).to_numpy()
                reached = near >= low - 1e-8
                rows, found, said = [], [], []
                for a in np.flatnonzero(reached.any(axis=1)):
                    b = np.flatnonzero(reached[a])
                    # added up in order, as a sum over the components one by one is
                    value = np.add.accumulate(x[a] * y[b], axis=1)[:, -1]
                    order = np.lexsort((place[b], -value))
                    b, value = b[order], value[order]
                    # of copies the k least ids
                    new = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
                    few = np.arange(len(b)) - np.repeat(new, np.diff(np.append(new, len(b)))) < k
                    rows.append(np.full(few.sum(), a))
                    found.append(b[few])
                    said.append(value[few])
                if rows:
                    yield pa.RecordBatch.from_arrays([query.take(pa.array(np.concatenate(rows))), key.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(said))], ["query", "id", "similarity"])

    met = pairs.mapInArrow(run, f"query {kinds['query']}, id {kinds['id']}, similarity double")
    return met.select("query", "id", F.round("similarity", 9).alias("similarity"))


def search(queries: DataFrame, path: str, k: int = 30, threshold: float = -math.inf, version: int = 0) -> DataFrame:
    """(query, id, similarity, rank): for each query (query, vec) its k vectors of the greatest dot products, exactly; those below the threshold are dropped.

    Queries look into the most promising cells first, and then into those whose bound still
    reaches the k-th best. Only these partitions are read. Ties go by id; similarities have nine decimals.
    """
    spark = queries.sparkSession
    cells = spark.read.parquet(f"{path}/cells/v{version}").collect()
    stored = spark.read.parquet(f"{path}/vectors").select("id", F.col("vec").alias("other"), "cell")

    def best(tried: DataFrame) -> DataFrame:
        return top_per_group(_met(tried, stored, k, threshold), "query", [F.desc("similarity"), F.col("id")], k)

    first = cut(best(_tried(queries, cells, k, False)))
    least = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("least")).withColumnRenamed("query", "_q")
    more = queries.join(least, F.col("query") == F.col("_q"), "left")
    rest = best(_tried(more, cells, k, True))
    out = top_per_group(first.drop("rank").union(rest.drop("rank")), "query", [F.desc("similarity"), F.col("id")], k)
    return out.where(F.col("similarity") >= threshold)


def looked_into(queries: DataFrame, path: str, k: int = 30, version: int = 0) -> DataFrame:
    """(query, n, cells): how many cells each query looks into first, and how many there are."""
    cells = queries.sparkSession.read.parquet(f"{path}/cells/v{version}").collect()
    return _tried(queries, cells, k, False).groupBy("query").agg(F.count("*").alias("n"), F.lit(len(cells)).alias("cells"))
