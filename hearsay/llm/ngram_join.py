"""Documents whose sets of word n-grams have a Jaccard similarity above a threshold, by prefix filters under several orders.

Under any order of all shingles, two sets with a Jaccard similarity of at least t share one of
their first n - ceil(t n) + 1 shingles. So linked documents share prefixes under every order, and
what fails one of them needs no verification.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm import textops as tx
from hearsay.llm.components import connected_components, spread_join
from hearsay.llm.lineage import cut, stored
from hearsay.llm.near_dup import COMMON, FEW, MAP, confirmed, linked, rare_pairs, room_left

SHINGLE, PERCENT = 5, 80
#: Seeds of the orders by hash: the first one makes buckets, the others filter pairs.
ORDERS = (11, 12, 13)
#: Members of a bucket up to which those of different components meet there.
SMALL = 64
#: Times that the shingles of larger buckets are put at the end of the order, before the rest meets by frequency.
ROUNDS = 4
_NAMES = [f"p{i}" for i in range(len(ORDERS))]


def _shingled(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows, with repeats, and where each row's begin (n + 1)."""
    return tx.shingles(*tx.words(column), shingle)


def _ranked(shingled: tuple[np.ndarray, np.ndarray], seed: int, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and place value of the distinct shingles of each row, in the order that seed names; those in last (sorted) come last."""
    value, at = tx.mix(shingled[0] + tx.constants(1, seed)), shingled[1]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            value[a:b].sort()
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    new = np.ones(len(value), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    if last is not None and len(last) and len(value):
        late = last[np.minimum(np.searchsorted(last, value), len(last) - 1)] == value
        order = np.argsort(2 * row + late, kind="stable")
        row, value = row[order], value[order]
    return row, value


def _prefix(row: np.ndarray, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ranked shingles are in the prefix of their row, and how many are, by row."""
    size = np.bincount(row, minlength=rows)
    most = np.where(size > 0, size + (-size * percent // 100) + 1, 0)
    return np.arange(len(row)) - np.searchsorted(row, row) < most[row], most


def _lists(size: np.ndarray, value: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), value)


def profiles(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, prefix) of whole texts (doc_id, text).

    prefix has the first shingles under the first of ORDERS, in that order; set_a and set_b are a
    digest of the set. A null or empty text has no shingles and an empty prefix.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.row_slices(batch.column(1)):
                ids, rows = batch.column(0)[part], part.stop - part.start
                row, value = _ranked(_shingled(batch.column(1)[part], shingle), ORDERS[0])
                first, most = _prefix(row, rows, percent)
                size = np.bincount(row, minlength=rows)
                at = np.concatenate([[0], np.cumsum(size)])
                digest = np.zeros((rows, 2), np.uint64)
                for i in np.flatnonzero(size):
                    digest[i] = np.frombuffer(hashlib.blake2b(value[at[i] : at[i + 1]].tobytes(), digest_size=16).digest(), np.uint64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int64)), tx.signed(digest[:, 0].copy()), tx.signed(digest[:, 1].copy()), _lists(most, tx.signed(value[first]))], ["doc_id", "n_shingles", "set_a", "set_b", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, prefix array<long>")


def _reordered(docs: DataFrame, shingle: int, percent: int, last: np.ndarray) -> DataFrame:
    """(doc_id, size, rank, s): the prefixes of whole texts under the first of ORDERS, but with the shingles of last at its end."""
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.row_slices(batch.column(1)):
                rows = part.stop - part.start
                row, value = _ranked(_shingled(batch.column(1)[part], shingle), ORDERS[0], shared.value)
                first, _ = _prefix(row, rows, percent)
                size = np.bincount(row, minlength=rows)[row]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part].take(pa.array(row[first])), pa.array(size[first].astype(np.int64)), pa.array(rank[first].astype(np.int32)), tx.signed(value[first])], ["doc_id", "size", "rank", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, rank int, s long")


def filters(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, map, p0, p1, ...) of whole texts that have shingles: what a pair is tried by before its texts are.

    map has a bit for each of 64 * MAP cells that a shingle falls in; p0 and so on are the prefixes
    under each of ORDERS, a shingle cut to 32 bits, which can only let more pairs through.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.row_slices(batch.column(1)):
                rows, lists, own = part.stop - part.start, [], _shingled(batch.column(1)[part], shingle)
                for seed in ORDERS:
                    row, value = _ranked(own, seed)
                    first, most = _prefix(row, rows, percent)
                    lists.append(_lists(most, pa.array((value[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))))
                cells = np.zeros((rows, 64 * MAP), np.uint8)
                cells[row, (value % np.uint64(64 * MAP)).astype(np.int64)] = 1
                cells = np.packbits(cells, axis=1).view(np.uint64)
                n = pa.array(np.bincount(row, minlength=rows).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], n, _lists(np.full(rows, MAP), tx.signed(cells.reshape(-1))), *lists], ["doc_id", "n", "map", *_NAMES])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, map array<long>, " + ", ".join(f"{p} array<int>" for p in _NAMES))


def _of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ids, which are broadcast if a count finds them few enough."""
    ids = ids.select("doc_id")
    return texts.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", "left_semi")


def _meeting(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) that share prefixes under each of ORDERS, and whose bit maps leave room for the threshold."""
    pairs = stored(pairs)
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    own = stored(filters(_of(texts, ids), shingle=shingle, percent=percent))
    side = F.struct("n", "map", *_NAMES)
    both = pairs.join(own.select(F.col("doc_id").alias("a"), side.alias("x")), "a").join(own.select(F.col("doc_id").alias("b"), side.alias("y")), "b")
    met = room_left("x", "y", percent)
    for p in _NAMES:
        met = met & F.arrays_overlap(f"x.{p}", f"y.{p}")
    return both.where(met).select("a", "b").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Documents are linked if 100 * shared >= percent * all of their distinct shingles;
    component_id is the smallest doc_id reachable over links.

    Equal sets form one class first. Documents that share a prefix shingle under the first order
    form a bucket; a bucket's hub is the document with most company in all its buckets. First each
    document is compared with the one hub that it shares most with. Then, in buckets that still
    hold several components, members of different components meet, if their places in the order
    leave room for the threshold. The shingles of buckets with over
    SMALL members go to the end of the order, and their members get new prefixes under the changed
    order, up to ROUNDS times; who is in a large bucket even then meets by rarest shingles, that is
    under the order by frequency (rare_pairs). So a large group of near
    copies needs about a comparison for each member, and a common passage brings nobody together.
    Of all these pairs, those go on that share prefixes under every one of ORDERS and whose
    sets' bit maps leave room for the threshold; every link is confirmed on full sets. All filters are
    necessary conditions for a link between components, so none is lost.

    Nulls: a null text equals an empty one; both have no shingles and no links. A row with a null
    doc_id has a null component_id. Whole texts count, however long; a text with fewer words than a
    shingle is one shingle. doc_id is a key; rows that share one count as one document where the
    id stands for both. An empty table gives no rows. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    text = texts.where("doc_id is not null")
    sig = stored(profiles(texts, shingle=shingle, percent=percent))
    node = sig.where("doc_id is not null and n_shingles > 0")
    classes = node.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    copies = stored(node.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).where("doc_id <> rep").select("doc_id", "set_a", "set_b").distinct())
    first = node.join(F.broadcast(copies) if copies.count() <= FEW else copies, ["doc_id", "set_a", "set_b"], "left_anti")
    bucket = first.select("doc_id", F.col("n_shingles").alias("size"), F.posexplode("prefix").alias("rank", "s"))
    shared = cut(bucket.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    member = stored(spread_join(bucket, shared.withColumn("k", F.col("n")), "s", total))

    company = member.groupBy("doc_id").agg(F.sum("k").alias("company"))
    hub = member.join(company, "doc_id").groupBy("s").agg(F.count("*").alias("n"), F.max(F.struct("company", -F.col("doc_id"), F.col("doc_id").alias("hub")))["hub"].alias("hub"))
    met = spread_join(member.select("s", "doc_id", "size"), hub.select("s", "n", "hub"), "s", total).where("doc_id <> hub")
    spoke = met.groupBy("doc_id", "hub", "size").agg(F.count("*").alias("common")).groupBy("doc_id").agg(F.max(F.struct("common", -F.col("hub"), "hub", "size")).alias("y"))
    # near copies share most of their prefixes; whom this leaves out meets below
    spoke = spoke.where(f"4 * y.common * 100 >= y.size * {100 - percent}").select("doc_id", "y.hub")
    pair = spoke.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    link = confirmed(_meeting(pair, text, shingle, percent), text, shingle).where(linked(percent)).select("a", "b")
    found = connected_components(link)

    component = found.select(F.col("node").alias("doc_id"), "component")
    pairs, last, crowd = [], np.zeros(0, np.uint64), None
    for k in range(ROUNDS):
        if k:
            rows = stored(_reordered(_of(text, crowd), shingle, percent, last))
            shared = cut(rows.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"))
            total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            member = spread_join(rows, shared.withColumn("k", F.col("n")), "s", total)
        named = member.join(component, "doc_id", "left").select("s", "doc_id", "size", "rank", F.coalesce("component", "doc_id").alias("c"))
        mixed = named.groupBy("s").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").withColumn("many", F.col("n"))
        left = stored(spread_join(named, mixed.select("s", "n", "many"), "s", total))
        few = left.where(f"many <= {SMALL}")
        x, y = few.alias("x"), few.alias("y")
        room = F.expr(f"(1 + least(x.size - 1 - x.rank, y.size - 1 - y.rank)) * {100 + percent} >= {percent} * (x.size + y.size)")
        pairs.append(stored(x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.doc_id") < F.col("y.doc_id")) & room).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()))
        crowd = stored(left.where(f"many > {SMALL}").select("doc_id", F.col("size").alias("n"), "c").distinct())
        # at most COMMON, the most frequent: 4 MB
        often = left.where(f"many > {SMALL}").groupBy("s").agg(F.max("many").alias("many")).orderBy(F.desc("many"), "s").limit(COMMON).select("s").toArrow()["s"].to_numpy()
        if not len(often) or len(last) + len(often) > COMMON:
            break
        last = np.union1d(last, often.view(np.uint64))
    pair = pairs[0]
    for other in pairs[1:]:
        pair = pair.union(other)
    if not crowd.isEmpty():
        pair = pair.union(rare_pairs(crowd, text, shingle, percent))
    pair = pair.distinct()
    more = confirmed(_meeting(pair, text, shingle, percent), text, shingle).where(linked(percent)).select("a", "b")
    if not more.isEmpty():
        found = connected_components(link.union(more))

    label = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    named = sig.join(label, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    return named.select("doc_id", "n_shingles", component.alias("component_id"))
