"""A hashed maximum-entropy language model with a class-factored softmax.

A word is a path of `depth` digits of base 16, its class, the class within that and so on, to a
leaf. P(word | history) is the product of P(digit | digits before, history) along the path, and of
the word's share of its leaf. Each digit's distribution is a log-linear model: a softmax over 16
outcomes, whose scores add up from hashed features of the three words before (n-grams: one word
back, both words back together; skips: two back alone, three back alone; and the ending of the word
before) crossed with the digits before. So the history takes part in all of the path. Frequent words have a leaf each; the others' first digits
come from their endings, the rest from their hash. Depth, rows of the feature tables and the number
of lanes grow with the training tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm import textops as tx
from hearsay.llm.lineage import stored

#: Outcomes of a digit, features of a token, and frequent words that have a leaf each.
BASE, FEATURES, KNOWN = 16, 5, 1024
#: Tokens for each leaf and for each row of a feature table, and the bounds of depth and of a table's rows (as powers of two). The upper bounds keep the weights under 350 MB.
LEAF_TOKENS, ROW_TOKENS, DEPTHS, ROW_BITS = 1 << 16, 1 << 15, (3, 5), (13, 16)
#: For each row of a table: training tokens of a lane, and tokens of a gradient step; rate of the steps, and the squares that they begin with.
LANE_TOKENS, STEP, RATE, SQUARE = 1024, 4, 0.15, 0.1
#: Characters of text that are scored together, and chunks of a task beyond the session's number of tasks.
CHUNK, TASK_CHUNKS = 4_000_000, 16
#: Least number of parts of the counts, and tokens of a part beyond that.
PARTS, PART_TOKENS = 64, 1 << 22
END = np.uint64(0x9D39247E33776D41)
_BLOCKS = 64
_START = np.uint64(0x3C6EF372FE94F82B)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of all rows, each row's words and then one end; their endings' hashes; and offsets by row."""
    text, offsets = tx.raw(texts)
    text = tx.lowered(text)
    starts, ends, by_row = tx.word_spans(text, offsets)
    word = tx.hash_spans(text, starts, ends)
    # words with letters beyond ASCII are told from others by the last of these, others by their last two letters
    high = np.flatnonzero(text >= 128)
    last_high = high[np.clip(np.searchsorted(high, ends) - 1, 0, None)] if len(high) else np.zeros(len(ends), np.int64)
    wide = (last_high >= starts) & (last_high < ends) & bool(len(high))
    before = np.maximum(ends - 2, starts)
    low = text[before].astype(np.uint64) << np.uint64(8) | text[ends - 1] if len(ends) else np.zeros(0, np.uint64)
    top = np.uint64(1 << 20) | text[np.where(wide, last_high, 0)].astype(np.uint64) if len(ends) else low
    ending = tx.mix(np.where(wide, top, low) + np.uint64(99))
    ending = ending & ~np.uint64(1) | wide.astype(np.uint64)
    at = by_row[1:]
    return np.insert(word, at, END), np.insert(ending, at, np.uint64(0)), by_row + np.arange(len(by_row))


@dataclass
class Model:
    """Frequent words in descending order (the end first), tokens and words by leaf, and weights [digit, feature, row, outcome]."""

    frequent: np.ndarray
    depth: int
    row_bits: int
    tokens: int = 0
    words: int = 0
    leaf_tokens: np.ndarray | None = None
    leaf_words: np.ndarray | None = None
    weights: np.ndarray | None = None
    parts: int = PARTS

    def __post_init__(self) -> None:
        self.order = np.argsort(self.frequent)
        self.sorted = self.frequent[self.order]
        if self.leaf_tokens is not None:
            self.bias = []
            for k in range(self.depth):
                n = self.leaf_tokens.reshape(BASE**k, BASE, -1).sum(axis=2) + 0.5
                self.bias.append(np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32))

    def leaves(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """The leaf of each word. A quarter of the first digits is for frequent words, another for words with letters beyond ASCII."""
        at = np.minimum(np.searchsorted(self.sorted, word), len(self.sorted) - 1)
        low = BASE ** (self.depth - 2)
        own = self.order[at] * (4 * BASE * low // KNOWN if 4 * BASE * low >= KNOWN else 1)
        wide = (ending & np.uint64(1)) > 0
        x = tx.mix(ending + np.uint64(5))
        first = np.where(wide, 4 + x % np.uint64(4), 8 + x % np.uint64(8)).astype(np.int64)
        second = (tx.mix(ending + np.uint64(17)) % np.uint64(BASE)).astype(np.int64)
        other = (first * BASE + second) * low + (tx.mix(word + np.uint64(3)) % np.uint64(low)).astype(np.int64)
        return np.where(self.sorted[at] == word, own, other)

    def histories(self, word: np.ndarray, ending: np.ndarray, by_row: np.ndarray) -> np.ndarray:
        """Hashes of the features of each token's history: [feature, token]."""
        place = np.arange(len(word)) - np.repeat(by_row[:-1], np.diff(by_row))

        def back(x: np.ndarray, k: int) -> np.ndarray:
            out = np.full(len(x), _START)
            out[k:] = np.where(place[k:] >= k, x[:-k], _START)
            return out

        one, two, three = (back(word, k) for k in (1, 2, 3))
        keys = one, two, three, tx.mix(one) + two, back(ending, 1)
        return np.stack([tx.mix(x + np.uint64(7919 * (i + 1))) for i, x in enumerate(keys)])

    def digit(self, k: int, leaf: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the k-th digit of leaves: the digits before as one number, the digit, and the rows of the weights [feature, token]."""
        path = leaf // BASE ** (self.depth - 1 - k)
        before = path // BASE
        row = history ^ (before.astype(np.uint64) + np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15)
        row *= np.uint64(0xD6E8FEB86659FD93)
        row >>= np.uint64(64 - self.row_bits)
        return before, path % BASE, row.view(np.int64)

    def distribution(self, k: int, before: np.ndarray, row: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Probabilities of all outcomes of the k-th digit: [token, outcome]."""
        z = self.bias[k][before]
        for f in range(FEATURES):
            z += np.take(weights[k, f], row[f], axis=0)
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def log_shares(self, leaf: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Log10 of each word's share of its leaf, one beyond its words left for unseen ones."""
        return np.log10(count + 1) - np.log10(self.leaf_tokens + self.leaf_words + 1)[leaf]

    def log_paths(self, leaf: np.ndarray, history: np.ndarray) -> np.ndarray:
        """Log10 probability of each token's leaf after its history, in batches that look up only the rows they need."""
        out = np.zeros(len(leaf))
        for at in range(0, len(leaf), 1 << 13):
            part = slice(at, at + (1 << 13))
            for k in range(self.depth):
                before, y, row = self.digit(k, leaf[part], history[:, part])
                out[part] += np.log10(self.distribution(k, before, row, self.weights)[np.arange(len(y)), y])
        return out

    def learn(self, weights: np.ndarray, squares: np.ndarray, leaf: np.ndarray, history: np.ndarray) -> None:
        """One adaptive gradient step over a batch of tokens, in place."""
        rows = 1 << self.row_bits
        for k in range(self.depth):
            before, y, row = self.digit(k, leaf, history)
            z = self.distribution(k, before, row, weights)
            z[np.arange(len(y)), y] -= 1
            error = np.ascontiguousarray(z.T, np.float64)
            for f in range(FEATURES):
                g = np.stack([np.bincount(row[f], weights=e, minlength=rows) for e in error], axis=1).astype(np.float32)
                square = g * g
                squares[k, f] += square
                np.sqrt(squares[k, f], out=square)
                g /= square
                g *= np.float32(RATE)
                weights[k, f] -= g


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, c): count of each token of docs (text), by hash; tasks count ahead of the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.row_slices(batch.column(0), 1 << 22):
                word, ending, _ = tokens(batch.column(0)[part])
                own, first, n = np.unique(word, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([tx.signed(own), tx.signed(ending[first]), pa.array(n.astype(np.int64))], ["word", "ending", "n"])

    return docs.select("text").mapInArrow(run, "word long, ending long, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("c"))


def _packed(x: np.ndarray) -> bytes:
    """Numbers by the rank of their bytes, compressed, after their length."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(pa.decompress(data[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T).tobytes(), kind)


def _dealt(key: np.ndarray, parts: int) -> Iterator[tuple[int, slice, bytes]]:
    """Sorted distinct hashes by parts of equal ranges: part, place, and the steps from each to the next, packed."""
    part = (key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    edge = np.flatnonzero(np.diff(part, prepend=np.uint64(parts))).tolist()
    for a, b in zip(edge, [*edge[1:], len(key)]):
        yield int(part[a]), slice(a, b), _packed(np.diff(key[a:b], prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _distinct(keys: list[np.ndarray]) -> np.ndarray:
    """All of them in order, each once; a sort takes less than np.unique's hash table."""
    key = np.sort(np.concatenate([np.zeros(0, np.uint64), *keys]))
    return key[np.flatnonzero(np.diff(key, prepend=~key[:1]))]


def packed_counts(counts: DataFrame, parts: int) -> DataFrame:
    """(part, keys, n): the words of counts (word, c) and their counts, packed by part."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        word, n = (np.concatenate([b.column(k).to_numpy() for b in held]).astype(np.int64).view(np.uint64) for k in (0, 1))
        order = np.argsort(word)
        part, keys, ns = zip(*((p, keys, _packed(n[order][at])) for p, at, keys in _dealt(word[order], parts)))
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(ns, pa.binary())], ["part", "keys", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= CHUNK // 4:
                yield pack(held)
                held, rows = [], 0
        if held:
            yield pack(held)

    return counts.select("word", "c").mapInArrow(run, "part int, keys binary, n binary")


def _trained(docs: DataFrame, model: Model, part: str, share: float) -> np.ndarray:
    """Mean of the weights that lanes reach by gradient steps over their training texts, weighted by tokens.

    Texts are dealt to lanes by a hash of the row and come in its order, so a lane's steps do not
    depend on how the table was partitioned. A lane starts from the model's weights and takes one
    step for STEP times as many tokens as a table has rows. What lanes return are blocks of weights
    in half precision, summed in two steps, each in order of lanes, so that no task gets all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = 1 << model.row_bits
    lanes = max(1, round(model.tokens * share / (LANE_TOKENS * rows)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weights, squares = own.weights.copy(), np.full(own.weights.shape, SQUARE, np.float32)
        seen, lane, held, n, batch_size = 0, 0, [], 0, STEP * rows

        def step() -> None:
            leaf, history = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)
            stop = len(leaf) if last else len(leaf) // batch_size * batch_size
            for at in range(0, stop, batch_size):
                own.learn(weights, squares, leaf[at : at + batch_size], history[:, at : at + batch_size])
            held[:] = [(leaf[stop:], history[:, stop:])]

        last = False
        for batch in batches:
            if batch.num_rows:
                lane = batch.column(1)[0].as_py()
            for some in tx.row_slices(batch.column(0)):
                word, ending, by_row = tokens(batch.column(0)[some])
                held.append((own.leaves(word, ending), own.histories(word, ending, by_row)))
                seen, n = seen + len(word), n + len(word)
                if n >= batch_size:
                    step()
                    n = len(held[0][0])
        if seen:
            last = True
            step()
            data = [x.tobytes() for x in np.split(weights.astype(np.float16).reshape(-1), _BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array([lane] * _BLOCKS, pa.int64()), pa.array([lane % 32] * _BLOCKS, pa.int64()), pa.array([seen] * _BLOCKS, pa.int64()), pa.array(data, pa.binary())], ["block", "lane", "group", "seen", "data"])

    def add(kind: type):
        def summed(table: pa.Table) -> pa.Table:
            """Weights of lanes times their tokens, or such sums, added up."""
            table = table.sort_by("lane")
            total = 0.0
            for x, n in zip(table["data"], table["seen"].to_pylist()):
                own = np.frombuffer(x.as_py(), kind).astype(np.float64)
                total = total + (own * n if kind is np.float16 else own)
            return pa.table({"block": table["block"][:1], "lane": table["lane"][:1], "group": table["group"][:1], "seen": pa.array([sum(table["seen"].to_pylist())], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

        return summed

    schema = "block int, lane long, group long, seen long, data binary"
    out = docs.where(part).select("text", F.pmod("h", F.lit(lanes)).alias("lane"), "h").repartitionById(lanes, F.col("lane").cast("int")).sortWithinPartitions("h", "text").select("text", "lane").mapInArrow(run, schema)
    out = out.groupBy("block", "group").applyInArrow(add(np.float16), schema).groupBy("block").applyInArrow(add(np.float64), schema).collect()
    if not out:
        return model.weights
    return np.concatenate([np.frombuffer(r.data) / r.seen for r in sorted(out, key=lambda r: r.block)]).reshape(model.weights.shape).astype(np.float32)


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """A model of docs (text), all of it, and the counts (word, ending, c) of its tokens.

    Training passes once over all texts in two rounds: a quarter of them, chosen by a hash, then
    the others from the mean of the first round's weights. Only the frequent words, sums by leaf
    and the weights, all of bounded sizes, come to the driver. The result depends on the rows
    alone. Null texts are empty. Other columns only spread rows that have equal texts.
    """
    own = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(*(F.col(c).cast("string") for c in sorted(docs.columns)), F.lit("fit")).alias("h"))
    counts = stored(word_counts(own))
    end = int(np.array([END]).view(np.int64)[0])
    total, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    depth = next((d for d in range(*DEPTHS) if BASE**d * LEAF_TOKENS >= total), DEPTHS[1])
    row_bits = min(max((total // ROW_TOKENS).bit_length(), ROW_BITS[0]), ROW_BITS[1])
    top = counts.where(F.col("word") != end).orderBy(F.desc("c"), "word").limit(min(KNOWN, 4 * BASE ** (depth - 1)) - 1).collect()
    frequent = np.concatenate([[END], np.array([r.word for r in top], np.int64).view(np.uint64)])
    paths = Model(frequent, depth, row_bits)

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, ending = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(paths.leaves(word, ending)), batch.column(2)], ["leaf", "c"])

    table = counts.select("word", "ending", "c").mapInArrow(leaves, "leaf long, c long").groupBy("leaf").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    n, v = np.zeros(BASE**depth), np.zeros(BASE**depth)
    n[table["leaf"].to_numpy()], v[table["leaf"].to_numpy()] = table["n"].to_numpy(), table["v"].to_numpy()
    weights = np.zeros((depth, FEATURES, 1 << row_bits, BASE), np.float32)
    model = Model(frequent, depth, row_bits, total, words, n, v, weights, max(PARTS, total // PART_TOKENS))
    for part, share in (("pmod(h div 1048576, 4) = 0", 0.25), ("pmod(h div 1048576, 4) <> 0", 0.75)):
        model = replace(model, weights=_trained(own, model, part, share))
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text, held_out).

    Texts are dealt by a hash to chunks of a bounded size. Each chunk asks for the counts of its
    distinct words, one packed row for a chunk and part of the counts, and gets them back beside
    its texts, so no vocabulary is held whole anywhere. base_score is the sum over tokens of
    log10((c + 1) / (N + V + 1)), score the model's log10 probability of the text. A null text
    has an end only. Repeated rows are scored alike; those that agree in doc_id, a key, and text
    share a chunk. Other columns are ignored.
    """
    own = docs.select("doc_id", "held_out", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    chunks = size // CHUNK + 1
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks, lists = max(least, chunks // TASK_CHUNKS), max(least, model.parts // TASK_CHUNKS)
    own = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(tasks, "chunk")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def ask(table: pa.Table) -> pa.Table:
        column = table["text"].combine_chunks()
        words = _distinct([np.unique(tokens(column[rows])[0]) for rows in tx.row_slices(column)])
        part, _, keys = zip(*_dealt(words, shared.value.parts))
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()] * len(part), pa.int64()), "part": pa.array(part, pa.int32()), "keys": pa.array(keys, pa.binary())})

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, np.uint64), *(_keys(k.as_py()) for k in left["keys"])])
        n = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(n.as_py(), np.uint64) for n in left["n"])])
        order = np.argsort(known)
        known, n = np.append(known[order], np.uint64(2**64 - 1)), np.append(n[order], np.uint64(0))
        out = []
        for keys in right["keys"]:
            key = _keys(keys.as_py())
            at = np.searchsorted(known, key)
            out.append(_packed(np.where(known[at] == key, n[at], np.uint64(0))))
        return pa.table({"chunk": right["chunk"], "part": right["part"], "n": pa.array(out, pa.binary())})

    asked = own.groupBy("chunk").applyInArrow(ask, "chunk long, part int, keys binary")
    told = packed_counts(counts, model.parts).repartition(lists, "part").groupBy("part").cogroup(asked.repartition(lists, "part").groupBy("part")).applyInArrow(tell, "chunk long, part int, n binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m: Model = shared.value
        column = left["text"].combine_chunks()
        told = sorted(zip(right["part"].to_pylist(), right["n"].to_pylist(), strict=True))
        count = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(n, np.uint64) for _, n in told)]).astype(np.int64)
        slices = list(tx.row_slices(column))
        key = _distinct([np.unique(tokens(column[rows])[0]) for rows in slices])
        out = np.zeros((4, len(column)))
        for rows in slices:
            word, ending, by_row = tokens(column[rows])
            c = count[np.searchsorted(key, word)]
            base = np.log10(c + 1) - np.log10(m.tokens + m.words + 1)
            leaf = m.leaves(word, ending)
            own = m.log_paths(leaf, m.histories(word, ending, by_row)) + m.log_shares(leaf, c)
            for k, x in enumerate((np.ones(len(word)), c > 0, base, own)):
                out[k, rows] = np.add.reduceat(x.astype(float), by_row[:-1])
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": pa.array(out[0].astype(np.int64)), "n_known": pa.array(out[1].astype(np.int64)), "train_tokens": pa.array([m.tokens] * len(column), pa.int64()), "base_score": pa.array(out[2]), "score": pa.array(out[3])})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return own.groupBy("chunk").cogroup(told.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(run, schema)
