"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact verification."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hearsay.llm import textops as tx

SHINGLE, PERCENT, RADIUS = 5, 75, 15
#: Items and characters of one broadcast block of the benchmark, whose index takes at most about 170 MB; a larger benchmark takes more passes.
BLOCK_ITEMS, BLOCK_CHARS = 10_000, 8_000_000
_BLOCKS, _ONES, _LONGEST = 4, np.uint64(0x0101010101010101), 240


def fitted_size(n: int) -> int:
    """The window size that stands for n words: n up to 11, else rounded down to a multiple of four, 240 at most."""
    return n if n < 12 else min(n, _LONGEST) // 4 * 4


@dataclass
class Index:
    """A block of benchmark items: ids, word hashes, and by window size the fingerprints with their block lists.

    `sizes` has an item's own windows: the whole item, or pieces of 240 words that cover a longer
    one. `shorter` has windows within items for texts that are shorter than an item's window but
    long enough to be as similar as asked.
    """

    ids: pa.Array
    words: list[np.ndarray]
    shingle: int
    percent: int
    radius: int

    def __post_init__(self) -> None:
        own, shorter = [], []
        for i, w in enumerate(self.words):
            n = len(w)
            if not n:
                continue
            size = fitted_size(n)
            own += [(size, i, at) for at in sorted({*range(0, n - size + 1, _LONGEST), *([n - size] if n > _LONGEST else [])})]
            least = self.percent * (n - self.shingle + 1) // 100 + self.shingle - 1 if n >= self.shingle else n
            for k in sorted({fitted_size(m) for m in range(max(least, 1), n)} - {size}):
                if k < size:
                    shorter += [(k, i, at) for at in sorted({*range(0, n - k + 1, max(1, k // 8)), n - k})]
        self.sizes, self.shorter = self._by_size(own, True), self._by_size(shorter, False)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.sieve = np.zeros(1 << 20, np.uint8)
        for w in self.words:
            self.sieve[(grams(w, self.shingle) & np.uint64((1 << 20) - 1)).astype(np.int64)] = 1
        self.grams = [np.unique(grams(w, min(self.shingle, len(w))), return_counts=True) for w in self.words]

    def _by_size(self, own: list[tuple[int, int, int]], spread: bool) -> dict:
        sums = {i: running(self.words[i]) for i in {x[1] for x in own}}
        out = {}
        for size in sorted({x[0] for x in own}):
            rows = [x for x in own if x[0] == size]
            prints = np.array([simhash(sums[i][:, at : at + size + 1], size)[0] for _, i, at in rows], np.uint64)
            out[size] = np.array([x[1:] for x in rows], np.int64), prints, BlockLists(prints, self.radius, spread)
        return out


class BlockLists:
    """Multi-index of 64-bit fingerprints: for each of four blocks, the fingerprints listed by 16-bit value.

    Two fingerprints within the radius agree to within radius // 4 bits in one of the four blocks
    at least. A spread index lists each fingerprint under all values that near, so a query looks
    up one value a block; the other lists it under its own, and a query looks up all values that
    near. Neither misses any within the radius.
    """

    def __init__(self, prints: np.ndarray, radius: int, spread: bool) -> None:
        values = np.arange(1 << 16, dtype=np.uint16)
        near = values[np.bitwise_count(values) <= radius // _BLOCKS]
        self.prints, self.radius, self.own, self.asked = prints, radius, near if spread else near[:1], near[:1] if spread else near
        self.lists = []
        for b in range(_BLOCKS):
            listed = (prints.view(np.uint16)[b::_BLOCKS, None] ^ self.own).reshape(-1)
            order = np.argsort(listed, kind="stable")
            first = np.searchsorted(listed[order], np.arange((1 << 16) + 1)).astype(np.int32)
            self.lists.append((first, np.diff(first) > 0, (order // len(self.own)).astype(np.int32)))

    def within(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in query, place in prints) of all pairs within the radius."""
        pairs = []
        for b, (first, filled, listed) in enumerate(self.lists):
            value = query.view(np.uint16)[b::_BLOCKS]
            value = value if len(self.asked) == 1 else (value[:, None] ^ self.asked).reshape(-1)
            some = np.flatnonzero(np.take(filled, value))
            if not len(some):
                continue
            at = first[value[some]]
            n = first[value[some].astype(np.int64) + 1] - at
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, p = np.repeat(some // len(self.asked), n), listed[np.repeat(at, n) + step]
            close = np.bitwise_count(query[q] ^ self.prints[p]) <= self.radius
            pairs.append(q[close] * len(self.prints) + p[close])
        found = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        return found // max(len(self.prints), 1), found % max(len(self.prints), 1)


@functools.lru_cache(maxsize=1)
def _built(shared) -> Index:
    """The index of a broadcast block, built once in a worker process."""
    return Index(*shared.value)


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one sequence of words, in order."""
    if len(word) < k or not k:
        return np.zeros(0, np.uint64)
    weight = tx.constants(k, 901) | np.uint64(1)
    return tx.mix(sum(word[i : len(word) - k + 1 + i] * weight[i] for i in range(k)))


def running(word: np.ndarray) -> np.ndarray:
    """Running sums of the bits of all words' hashes: eight bit counters lie in the bytes of one 64-bit number."""
    out = np.zeros((8, len(word) + 1), np.uint64)
    mixed = tx.mix(word)
    for k in range(8):
        np.cumsum((mixed >> np.uint64(k)) & _ONES, out=out[k, 1:])
    return out


def simhash(sums: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHash over the words of each window of `size` words, at most 240, by its first word.

    A window is eight differences of running sums, and a majority is the top bit of a byte.
    """
    bias = _ONES * np.uint64(127 - size // 2)
    out = np.zeros(max(sums.shape[1] - size, 0), np.uint64)
    for k in range(8 if len(out) else 0):
        x = sums[k, size:] - sums[k, :-size]
        x += bias
        x >>= np.uint64(7)
        x &= _ONES
        x <<= np.uint64(k)
        out |= x
    return out


def _best(window: np.ndarray, item: tuple[np.ndarray, np.ndarray], m: int, percent: int) -> tuple[int, int, int] | None:
    """The stretch of m shingles in window that is most like the item, by multiplicities: (start, shared, union)."""
    value, count = item
    total = int(count.sum())
    at = np.searchsorted(value, window)
    at[at == len(value)] = 0
    at = np.where(value[at] == window, at, -1)
    if (100 + percent) * int((at >= 0).sum()) < percent * total:
        return None
    best = None
    for start in range(max(len(window) - m, 0) + 1):
        part = at[start : start + m]
        shared = int(np.minimum(np.bincount(part[part >= 0], minlength=len(value)), count).sum())
        union = len(part) + total - shared
        if 100 * shared >= percent * union and (best is None or shared * best[2] > best[1] * union):
            best = start, shared, union
    return best


def detect(index: Index, column: pa.Array) -> Iterator[tuple[int, int, int, float]]:
    """(row, item position, first word, similarity) of each item found in each text of a column, at its best place."""
    k = index.shingle
    for part in tx.row_slices(column):
        word, by_row = tx.words(column[part])
        if not len(word):
            continue
        sums, length = running(word), np.diff(by_row)
        left = np.repeat(by_row[1:], length) - np.arange(len(word))
        gram = grams(word, k)
        # running count of shingles that some item may have, to rule candidates out together
        known = np.concatenate([[0], np.cumsum(index.sieve[(gram & np.uint64(len(index.sieve) - 1)).astype(np.int64)])])
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        hits = []
        for size, (items, _, lists) in index.sizes.items():
            # a window at every word, but for those that reach into the next text
            starts = np.flatnonzero(left >= size)
            q, p = lists.within(simhash(sums, size)[starts])
            hits.append((items[p, 0], items[p, 1], starts[q], np.full(len(q), size)))
        # a text shorter than an item's window is compared with windows of its own size in the item
        for size, (items, _, lists) in index.shorter.items():
            rows = np.flatnonzero((length >= size) & (length < (size + 4 if size >= 12 else size + 1)))
            starts = np.concatenate([by_row[rows], by_row[rows + 1] - size])
            windows = np.array([simhash(sums[:, at : at + size + 1], size)[0] for at in starts.tolist()], np.uint64)
            q, p = lists.within(windows)
            hits.append((items[p, 0], items[p, 1], starts[q], np.full(len(q), size)))
        item, offset, start, size = (np.concatenate([h[c] for h in hits]) for c in range(4)) if hits else [np.zeros(0, np.int64)] * 4
        n, slack = index.length[item], size // 8 + 5
        row = np.searchsorted(by_row, start, side="right") - 1
        low, high = by_row[row], by_row[row + 1]
        first = np.maximum(low, np.minimum(start - offset - slack, high - n))
        stop = np.minimum(high, np.maximum(start - offset + n + slack, first + n))
        # of two sets as similar as asked, both have 2p / (1 + p) of the mean size in common
        need = index.percent * np.minimum(n - k + 1, stop - first) // (100 + index.percent)
        inside = known[np.clip(stop - k + 1, 0, len(known) - 1)] - known[np.clip(first, 0, len(known) - 1)]
        live = np.flatnonzero((n < k) | (inside >= need))
        # stretches of one text for one item that overlap are searched as one
        joined: list[list[int]] = []
        for r, i, f, s in sorted(zip(row[live].tolist(), item[live].tolist(), first[live].tolist(), stop[live].tolist(), strict=True)):
            if joined and joined[-1][:2] == [r, i] and f <= joined[-1][3]:
                joined[-1][3] = max(joined[-1][3], s)
            else:
                joined.append([r, i, f, s])
        for r, i, f, s in joined:
            size_of = min(k, int(n_of := index.length[i]))
            window = grams(word[f:s], size_of)
            if len(window) and (hit := _best(window, index.grams[i], n_of - size_of + 1, index.percent)):
                at, shared, union = hit
                old = found.get((r, i))
                if old is None or shared * old[2] > old[1] * union:
                    found[r, i] = f - int(by_row[r]) + at, shared, union
        for (r, i), (at, shared, union) in sorted(found.items()):
            yield part.start + r, i, at, shared / union


def _blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, shingle: int, percent: int, radius: int) -> Iterator[object]:
    """Broadcast indexes of the benchmark, each of a bounded part of it."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(math.ceil(n / BLOCK_ITEMS), math.ceil(chars / BLOCK_CHARS))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        word, by_row = tx.words(pa.array([r.text for r in rows], pa.large_string()))
        sequences = [word[by_row[i] : by_row[i + 1]] for i in range(len(rows))]
        ids = pa.array([r.item_id for r in rows], to_arrow_type(items.schema["item_id"].dataType))
        yield docs.sparkSession.sparkContext.broadcast((ids, sequences, shingle, percent, radius))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): each benchmark item that a text contains, at its most similar window.

    A text contains an item of n words if n consecutive words of it (or all, if it has fewer)
    have a Jaccard similarity of at least percent / 100 with the item, over five-word shingles
    weighted by how often each occurs. Windows of the item's size (rounded down to a multiple of
    four; pieces of 240 words of a longer item) are fingerprinted at every word of a text; the
    multi-index lookup finds all fingerprints within `radius` bits; candidates are verified
    exactly at every shift around. A text shorter than that is fingerprinted whole and looked up
    among windows of its size within the items.

    Nulls: a null text or item text contains nothing and is contained in nothing; ids may be
    null. Repeated rows give repeated results. An item of fewer than five words is one shingle.
    An empty table gives no rows. Other columns are ignored.
    """
    out = None
    kind = benchmark.schema[item_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, item_id {kind}, start_word long, similarity double"
    for shared in _blocks(docs, benchmark, item_col, item_text, shingle, percent, radius):

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _built(shared)
            for batch in batches:
                rows = list(detect(index, batch.column(1)))
                at = pa.array([r[0] for r in rows], pa.int64())
                ids = index.ids.take(pa.array([r[1] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), ids, pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.float64())], ["doc_id", "item_id", "start_word", "similarity"])

        part = own.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """docs without the rows whose text contains an item of the benchmark (see contamination); all columns stay.

    Rows are judged one by one where they lie: no join, no shuffle.
    """
    at = docs.columns.index(text_col)
    for shared in _blocks(docs, benchmark, item_col, item_text, shingle, percent, radius):

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _built(shared)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in detect(index, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
