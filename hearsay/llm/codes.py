"""Vector code compression: product codes of integer vectors, whose codebooks Spark refines round by round."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from hearsay.llm.components import spread_join
from hearsay.llm.lineage import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are compared with a codebook at a time.
STEP = 2048
_LONGS = ArrayType(LongType())


def integers(vectors: DataFrame, vec_col: str, scale: int = SCALE) -> DataFrame:
    """vectors with vec_col as whole numbers floor(scale * x), without rows whose vector is null or has null or non-finite components.

    Numbers are kept within the bound up to which the squared distance of two vectors is a long:
    2^30 / sqrt(components), that is x beyond 131,072 of 64 components. All other columns stay.
    """
    at = vectors.columns.index(vec_col)
    schema = StructType([StructField(f.name, f.dataType) if i != at else StructField(f.name, _LONGS, True) for i, f in enumerate(vectors.schema)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            good = column.is_valid().to_numpy(zero_copy_only=False)
            size = np.where(good, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            flat = column.flatten()
            x = flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            good = good & (np.bincount(row[~np.isfinite(x)], minlength=len(size)) == 0)
            x = x[good[row]]
            most = np.floor(2.0**30 / np.sqrt(np.maximum(size, 1)))[row[good[row]]]
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(x * scale), -most, most).astype(np.int64)
            whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[good])]).astype(np.int32)), pa.array(x))
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([c if i != at else whole for i, c in enumerate(kept.columns)], batch.schema.names)

    return vectors.mapInArrow(run, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column whose lists all have `width` numbers."""
    return column.flatten().to_numpy().reshape(len(column), width)


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, components of a part); zeros fill up a last part that is short."""
    short = -x.shape[1] % parts
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), parts, -1).transpose(1, 0, 2)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first nearest row of book and its squared distance, by |x|^2 - 2 x.b + |b|^2 in whole numbers."""
    own, other = (x * x).sum(axis=1), (book * book).sum(axis=1)
    entry, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), STEP):
        part = slice(at, at + STEP)
        d = other - 2 * (x[part] @ book.T)
        entry[part] = d.argmin(axis=1)
        distance[part] = own[part] + d[np.arange(len(d)), entry[part]]
    return entry, distance


def _refined(kept: DataFrame, vec_col: str, width: int, book: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry becomes the floored mean of the parts that are nearest to it."""
    spark = kept.sparkSession
    shared = spark.sparkContext.broadcast(book)
    parts, entries, length = book.shape

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, length), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, x in enumerate(_parts(_matrix(batch.column(0), width), parts)):
                entry = nearest(x, book[p])[0]
                order = np.argsort(entry, kind="stable")
                used, at = np.unique(entry[order], return_index=True)
                count[p] += np.bincount(entry, minlength=entries)
                total[p, used] += np.add.reduceat(x[order], at, axis=0)
        p, e = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * length, pa.int32()), pa.array(total[p, e].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), sums], ["part", "entry", "n", "sums"])

    met = kept.select(vec_col).mapInArrow(tally, "part long, entry long, n long, sums array<long>")
    each = [F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(length)]
    # at most parts * entries rows, as many as the codebooks have
    rows = met.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*each).alias("sums")).collect()
    book = book.copy()
    for r in rows:
        book[r.part, r.entry] = [int(s) // r.n for s in r.sums]
    return book


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): codes has vec_id, label, code, error for each kept vector; codebooks are whole numbers by part, entry and component.

    A vector's components become floor(scale * x), and it is cut into `parts` equal consecutive
    parts. A part's codebook starts as that part of the `entries` vectors of the smallest ids. In
    each round every part goes to its nearest entry (squared Euclidean distance, the first of equal
    ones), tasks add up what goes to each entry, a grouped shuffle merges their sums, and each
    entry with parts becomes their floored mean. code has two hex digits a part; error is the
    squared distance to what the code stands for. Codebooks are broadcast: parts * entries rows,
    whatever the table's size. All arithmetic is in whole numbers, so the result doesn't depend on
    the partitioning.

    Rows are dropped if their vector is null, has null or non-finite components, or another number
    of components than that of the smallest kept id. Null ids come last in the choice of
    entries; equal ids are told apart by their vectors. With fewer vectors than `entries`, the
    codebooks are as much smaller. A number of components that `parts` doesn't divide is filled up
    with zeros. An empty table gives no rows and codebooks without entries. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so there are 1 to 256 entries")
    own = stored(integers(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label")), "v", scale))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = own.orderBy(*order).limit(1).collect()
    width = len(first[0].v) if first else 0
    kept = own.where(F.size("v") == width)
    seeds = kept.orderBy(*order).limit(entries).collect()
    book = np.ascontiguousarray(_parts(np.array([r.v for r in seeds], np.int64).reshape(len(seeds), width), parts)) if seeds else np.zeros((parts, 0, 0), np.int64)
    if width:
        for _ in range(rounds):
            book = _refined(kept, "v", width, book)
    shared = own.sparkSession.sparkContext.broadcast(book)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            code, error = np.full(batch.num_rows, "", dtype=f"<U{2 * parts}"), np.zeros(batch.num_rows, np.int64)
            for p, x in enumerate(_parts(_matrix(batch.column(1), width), parts)):
                entry, distance = nearest(x, book[p])
                code, error = np.char.add(code, digits[entry]), error + distance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(code.tolist(), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    schema = StructType([own.schema["vec_id"], own.schema["label"], StructField("code", StringType()), StructField("error", LongType())])
    return stored(kept.mapInArrow(assign, schema)), book


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error: the sum of error over all rows with an equal label, nulls together (at most 2^63 - 1).

    Sums are partial ahead of the shuffle, and a label of many rows gets its sum back by spread_join.
    """
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1)).cast("long")
    total = codes.groupBy("label").agg(whole.alias("label_error"), F.count("*").alias("n"))
    # labels whose hashes are equal share a row, and are told apart in it
    found = total.groupBy(F.xxhash64("label").alias("label_hash")).agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.col("label").alias("of"), "label_error")).alias("known"))
    met = spread_join(codes.withColumn("label_hash", F.xxhash64("label")), found, "label_hash", codes.count())
    return met.select(*codes.columns, F.filter("known", lambda x: x["of"].eqNullSafe(F.col("label")))[0]["label_error"].alias("label_error"))


def codebook_digest(book: np.ndarray) -> str:
    """SHA-256 of all numbers of the codebooks in decimal, by part, entry and component, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
