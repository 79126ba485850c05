"""Near-duplicate documents by min-max hashing, with every link confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm import textops as tx
from hearsay.llm.components import connected_components, spread_join
from hearsay.llm.lineage import cut, fresh, stored

SHINGLE, PERCENT, ROWS, BANDS = 5, 75, 5, 40
#: Bits kept of each signature value, and longs of a set's bit map.
BITS, MAP = 3, 32
#: Comparisons a member of a bucket beyond which rare shingles choose the pairs.
CROSS = 128
#: Documents that have a shingle before it counts as common, and most shingles that do (12 bytes each).
RARE, COMMON = 16, 500_000
#: Most rows, of three longs at most, that are broadcast: 6 MB.
FEW = 250_000
#: Pairs of one document that get a copy of its text.
LANE = 64


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, bits, map) of whole texts.

    Min-max hashing: each of rows * bands / 2 permutations yields the least and the greatest
    value of a document's shingles, two signature values for one evaluation. `bands` holds a
    key for each band of `rows` values; set_a and set_b are a 128-bit digest of the set, and bits
    has BITS bits of each value, a plane of them after another. map has a bit for
    each of 64 * MAP cells that a shingle of the document falls in. A null or empty text has no
    shingles, bands, bits or map.
    """
    turns = (rows * bands + 1) // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = tx.constants(turns, 1) | np.uint64(1), tx.constants(turns, 2)
        weight = tx.constants(rows, 3) | np.uint64(1)
        tag = tx.constants(bands, 4)
        for batch in batches:
            for part in tx.row_slices(batch.column(1)):
                ids, text = batch.column(0)[part], batch.column(1)[part]
                own, at = tx.shingles(*tx.words(text), shingle)
                some = np.flatnonzero(np.diff(at))
                value = np.zeros((len(some), 2 * turns), np.uint64)
                for i in range(turns if len(some) else 0):
                    x = own * mul[i] + add[i]
                    value[:, 2 * i] = np.minimum.reduceat(x, at[some])
                    value[:, 2 * i + 1] = np.maximum.reduceat(x, at[some])
                keys = tx.mix((value[:, : rows * bands].reshape(len(some), bands, rows) * weight).sum(axis=2) + tag)
                planes = _planes(value[:, : rows * bands])
                cells = np.zeros((len(ids), 64 * MAP), np.uint8)
                cells[np.repeat(np.arange(len(ids)), np.diff(at)), (tx.mix(own) % np.uint64(64 * MAP)).astype(np.int64)] = 1
                cells = np.packbits(cells[some], axis=1).view(np.uint64).reshape(len(some), MAP)
                n = np.zeros(len(ids), np.int64)
                digest = np.zeros((len(ids), 2), np.uint64)
                for i in some:
                    distinct = np.unique(own[at[i] : at[i + 1]])
                    n[i] = len(distinct)
                    digest[i] = np.frombuffer(hashlib.blake2b(distinct.tobytes(), digest_size=16).digest(), np.uint64)
                lists = []
                for part_of in (keys, planes, cells):
                    size = np.zeros(len(ids) + 1, np.int32)
                    size[some + 1] = part_of.shape[1]
                    lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), tx.signed(part_of.reshape(-1))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), tx.signed(digest[:, 0].copy()), tx.signed(digest[:, 1].copy()), *lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits", "map"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>, map array<long>")


def _planes(value: np.ndarray) -> np.ndarray:
    """BITS bits of each value of a row, packed to longs plane by plane."""
    mixed = tx.mix(value)
    wide = -(-value.shape[1] // 64) * 64
    bit = np.zeros((len(value), BITS, wide), np.uint8)
    for k in range(BITS):
        bit[:, k, : value.shape[1]] = (mixed >> np.uint64(k)) & np.uint64(1)
    return np.packbits(bit.reshape(len(value), BITS * wide), axis=1).view(np.uint64).reshape(len(value), BITS * wide // 64)


def similarities(pairs: DataFrame, texts: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """(a, b, n_a, n_b, shared) for pairs (a, b): sizes of both full shingle sets and of what they share.

    texts is (doc_id, text). The pairs of a document are dealt to lanes of about LANE, each of which
    gets a copy of its text, so a document that meets many others is spread over tasks.
    """
    total = pairs.count()
    dealt, sides = pairs.select("a", "b"), {}
    for side, other in (("b", "a"), ("a", "b")):
        lanes = pairs.groupBy(side).agg(F.count("*").alias("n")).withColumn(f"lanes_{side}", F.expr(f"1 + n div {LANE}"))
        dealt = spread_join(dealt, lanes, side, total).withColumn(f"lane_{side}", F.expr(f"pmod(xxhash64({other}), lanes_{side})")).drop(f"lanes_{side}")
        lanes = lanes.select(F.col(side).alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"lanes_{side}") - 1)).alias(f"lane_{side}"))
        sides[side] = texts.join(lanes, "doc_id").select(F.col("doc_id").alias(side), f"lane_{side}", F.col("text").alias(f"text_{side}"))
    two = dealt.join(sides["b"], ["b", "lane_b"]).join(sides["a"], ["a", "lane_a"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.row_slices(batch.column(2), 1 << 19):
                a, b, first, second = (batch.column(i)[part] for i in (0, 1, 2, 3))
                (left, at), (right, to) = tx.shingles(*tx.words(first), shingle), tx.shingles(*tx.words(second), shingle)
                out = np.zeros((3, len(a)), np.int64)
                known, known_id = None, None
                for i, key in enumerate(a.to_numpy()):
                    if key != known_id:
                        known, known_id = np.unique(left[at[i] : at[i + 1]]), key
                    other = np.unique(right[to[i] : to[i + 1]])
                    out[:, i] = len(known), len(other), len(np.intersect1d(known, other, assume_unique=True))
                yield pa.RecordBatch.from_arrays([a, b, *map(pa.array, out)], ["a", "b", "n_a", "n_b", "shared"])

    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, n_a long, n_b long, shared long")


def linked(percent: int):
    return 100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))


def _promising(x: str, y: str, values: int, percent: int) -> Column:
    """Whether sizes and signature bits of two rows leave room for a similarity of percent / 100.

    A differing value differs in half of its bits. The bound lies 4.3 standard deviations below
    the threshold, so it loses a pair at the threshold with a probability of about 1e-5.
    """
    j = percent / 100
    deviation = math.sqrt(4 * ((1 - j) / (4 * BITS) + j * (1 - j) / 4) / values)
    most = math.floor((1 - j + 4.3 * deviation) / 2 * values * BITS)
    differ = sum(F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(BITS * -(-values // 64)))
    return (F.col(f"{x}.n") * percent <= F.col(f"{y}.n") * 100) & (F.col(f"{y}.n") * percent <= F.col(f"{x}.n") * 100) & (differ <= most)


def room_left(x: str, y: str, percent: int) -> Column:
    """Whether the bit maps of two rows leave room for a similarity of percent / 100.

    Cells that only one set has hold shingles that the other lacks, so they bound from above what
    both can share. The bound never rules out a link.
    """
    alone, other = (sum(F.bit_count(F.col(f"{p}.map")[i].bitwiseAND(F.bitwise_not(F.col(f"{q}.map")[i]))) for i in range(MAP)) for p, q in ((x, y), (y, x)))
    shared = F.least(F.col(f"{x}.n") - alone, F.col(f"{y}.n") - other)
    return shared * (100 + percent) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * percent


def roomy(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that room_left leaves."""
    known = own.select("doc_id", "n", "map")
    both = pairs.join(known.select(F.col("doc_id").alias("a"), F.struct("n", "map").alias("x")), "a").join(known.select(F.col("doc_id").alias("b"), F.struct("n", "map").alias("y")), "b")
    return both.where(room_left("x", "y", percent)).select("a", "b")


def rare_pairs(node: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): pairs of documents (doc_id, n, c) of different components c that share a rare shingle, every linked pair among them.

    A document's shingles are ordered by the number of documents that have them, rarest first; of
    that number only the level of the at most COMMON most common ones counts. Of a linked pair, the larger document has one of the smaller's first 1 - 2p / (1 + p) of its
    shingles among its own first 1 - p, and places that leave room for what both must share. So
    documents that are alike in what many others have too never meet. A shingle of many documents
    is split into lanes.
    """

    own = node.join(texts, "doc_id") if node.count() > FEW else texts.join(F.broadcast(node), "doc_id")
    own = own.select("doc_id", "n", "c", "text")

    def spelt(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and value of the distinct shingles of each row, by row and value."""
        value, at = tx.shingles(*tx.words(column), shingle)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        return row[new], value[new]

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.row_slices(batch.column(3), 1 << 23):
                value, n = np.unique(spelt(batch.column(3)[part])[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([tx.signed(value), pa.array(n.astype(np.int64))], ["s", "k"])

    many = stored(own.mapInArrow(tally, "s long, k long").groupBy("s").agg(F.sum("k").alias("df")).where(f"df > {RARE}").withColumn("level", F.expr("cast(floor(log2(df)) as int)")))
    # any set of shingles may come last in the order, as long as it is the same for all documents
    level, kept = 64, 0
    for r in sorted(many.groupBy("level").count().collect(), key=lambda r: -r.level):
        kept += r["count"]
        if kept > COMMON:
            break
        level = r.level
    table = many.where(F.col("level") >= level).select("s", "level").toArrow().sort_by("s")
    shared = node.sparkSession.sparkContext.broadcast((table["s"].to_numpy(), table["level"].to_numpy()))

    def begin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, level = shared.value
        for batch in batches:
            for part in tx.row_slices(batch.column(3), 1 << 23):
                row, value = spelt(batch.column(3)[part])
                at = np.minimum(np.searchsorted(common, value.view(np.int64)), max(len(common) - 1, 0))
                known = np.where(common[at] == value.view(np.int64), level[at], 0) if len(common) else np.zeros(len(value), np.int64)
                order = np.lexsort((value, known, row))
                row, value = row[order], value[order]
                size = np.bincount(row, minlength=part.stop - part.start)[row]
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                first = rank <= size - -(-size * percent // 100) + 1
                row = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([batch.column(0)[part].take(row), pa.array(size[first]), batch.column(2)[part].take(row), tx.signed(value[first]), pa.array(rank[first])], ["doc_id", "size", "c", "s", "rank"])

    ranked = stored(own.mapInArrow(begin, "doc_id long, size long, c long, s long, rank long"))
    total = ranked.count()
    lanes = ranked.groupBy("s").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("s", "n", F.expr("1 + n div 1000").alias("lanes"))
    met = spread_join(ranked, lanes, "s", total)
    probe = met.withColumn("lane", F.expr("pmod(xxhash64(doc_id), lanes)")).alias("x")
    index = met.where(f"rank <= size - (size * {2 * percent} + {99 + percent}) div {100 + percent} + 1").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1))).alias("y")
    larger = F.expr("x.size > y.size or (x.size = y.size and x.doc_id > y.doc_id)")
    room = F.expr(f"(1 + least(x.size - x.rank, y.size - y.rank)) * {100 + percent} >= {percent} * (x.size + y.size)")
    pair = probe.join(index, (F.col("x.s") == F.col("y.s")) & (F.col("x.lane") == F.col("y.lane")) & (F.col("x.c") != F.col("y.c")) & larger & room)
    return pair.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """similarities of pairs, for which only the texts of their documents are shuffled if a check finds their ids few enough to broadcast."""
    pairs = stored(pairs)
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    if ids.count() <= FEW:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    return stored(similarities(pairs, texts, shingle=shingle))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of distinct shingles have a Jaccard similarity of at
    least percent / 100. component_id is the smallest doc_id reachable over links, and kept
    marks the document that has it.

    Equal sets form one class first, so copies cost one row each however many there are. Rows
    that share a band key form a bucket. What is compared: first each member with its bucket's
    hub, the document with most company in all its buckets; then, in buckets whose members still
    belong to different components, members of different components. In a bucket where
    that would be over CROSS comparisons a member, rare shingles choose the pairs (see
    rare_pairs), which misses no link. So a large group of near copies needs about a comparison
    for each member, a large family of texts that are alike but not linked about as little, and
    no link between components is left untested. Before texts are fetched, a pair's sizes,
    signature bits and bit maps must leave room for the threshold; every link is then confirmed
    on full sets. Nothing is capped. A pair at exactly the threshold is missed with a probability
    of 3e-5 at 40 bands of 5, a closer one less.

    Nulls: a null text equals an empty one; both have no shingles and no links. A row with a
    null doc_id has a null component_id and is kept. doc_id is a key; rows that share one with
    different texts are labelled each, but where the id stands for both they count as one
    document. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    text = texts.where("doc_id is not null")
    sig = stored(signatures(texts, shingle=shingle, rows=rows, bands=bands))
    node = sig.where("doc_id is not null and n_shingles > 0")
    classes = node.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"))
    first = node.join(classes.select("doc_id").distinct(), "doc_id", "left_semi")
    bucket = first.select("doc_id", F.explode("bands").alias("band"))
    shared = cut(bucket.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    member = cut(spread_join(bucket, shared.withColumn("k", F.col("n")), "band", total))
    company = member.groupBy("doc_id").agg(F.sum("k").alias("company"))
    own = cut(company.join(first.select("doc_id", F.col("n_shingles").alias("n"), "bits", "map"), "doc_id"))
    member = member.select("band", "doc_id")

    values = rows * bands
    left = member.join(own.select("doc_id", "company", F.col("n").alias("size"), "bits"), "doc_id")
    hub = left.groupBy("band").agg(F.count("*").alias("n"), F.max(F.struct("company", -F.col("doc_id"), "doc_id", F.col("size").alias("n"), "bits")).alias("y"))
    met = spread_join(left, hub.select("band", "n", F.struct("y.doc_id", "y.n", "y.bits").alias("y")), "band", total)
    pair = met.select(F.struct("doc_id", F.col("size").alias("n"), "bits").alias("x"), "y").where((F.col("x.doc_id") != F.col("y.doc_id")) & _promising("x", "y", values, percent))
    # the hub comes first, so that its text is read once for all that it meets
    pair = roomy(pair.select(F.col("y.doc_id").alias("a"), F.col("x.doc_id").alias("b")).distinct(), own, percent)
    spoke = confirmed(pair, text, shingle)
    link = spoke.where(linked(percent)).select("a", "b")
    found = connected_components(link)

    named = member.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
    group = named.groupBy("band", "c").agg(F.count("*").alias("m")).groupBy("band").agg(F.sum("m").alias("n"), F.sum(F.col("m").cast("double") * F.col("m")).alias("alike"), F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("kinds"))
    group = group.where("kinds > 1").select("band", "n", "main", F.expr("1 + n div 10000").alias("lanes"), F.expr(f"(cast(n as double) * n - alike) / 2 > {CROSS} * n").alias("hot"))
    left = stored(spread_join(named, group, "band", total).join(own.select("doc_id", "n", "bits", "map"), "doc_id"))
    # in a bucket that isn't hot, all but one component have few members; those of the main one are dealt to lanes
    main = left.where("not hot and c = main").withColumn("lane", F.expr("pmod(xxhash64(doc_id), lanes)"))
    rest = left.where("not hot and c <> main")
    near = [
        main.alias("x").join(rest.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1))).alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.lane") == F.col("y.lane")) & _promising("x", "y", values, percent) & room_left("x", "y", percent)),
        rest.alias("x").join(rest.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.c") < F.col("y.c")) & _promising("x", "y", values, percent) & room_left("x", "y", percent)),
    ]
    pair = near[0].select("x.doc_id", F.col("y.doc_id").alias("other")).union(near[1].select("x.doc_id", F.col("y.doc_id").alias("other")))
    pair = pair.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    crowd = stored(left.where("hot").select("doc_id", "n", "c").distinct())
    if not crowd.isEmpty():
        pair = pair.union(roomy(rare_pairs(crowd, text, shingle, percent), own, percent)).distinct()
    pair = pair.join(spoke.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = confirmed(pair, text, shingle).where(linked(percent)).select("a", "b")
    if not more.isEmpty():
        found = connected_components(link.union(more))

    # copies of a set get the component of the class
    rep = classes.withColumnRenamed("doc_id", "rep")
    label = rep.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    named = sig.join(label, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that another of their group stands for; all columns stay.

    doc_id is a key: rows that share it are one document, so all of them stay or go. A row with a
    null doc_id stays.
    """
    name = fresh(docs, "gone")[0]
    gone = near_duplicates(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col] == F.col(name), "left_anti")
