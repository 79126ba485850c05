"""Toxic text by a support vector machine over a gap-weighted subsequence string kernel with Nyström landmarks.

The kernel compares words, and a text is what its most similar words are: for each landmark the
greatest kernel value of any of its words, taken relative to the landmark's own and cut at 1.25
(so a word that holds an insult among other letters keeps the insult's whole value), then whitened
by the landmarks' kernel matrix as in a Nyström map. Whitening such maxima is a max-pooled word
kernel, not the exact Nyström map of a kernel between texts. Beside it stand the amounts of near
matches by landmark. Texts of any length are taken apart in pieces of CHUNK bytes and more, the
longest single text at once; a null or empty text has no words, so all its features are 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm import textops as tx
from hearsay.llm.lineage import cut

ORDER, DECAY, LONGEST = 3, 0.6, 32
#: Labelled rows that the classifier is fitted on at most, and landmarks: those most tied to the label, and common words beside them.
MAX_LABELLED, TIED, COMMON = 12_000, 56, 8
#: Tasks that the sample is dealt to, and bytes of text and rows that a task takes apart at a time.
PARTS, CHUNK, ROWS = 24, 1 << 19, 1024
THRESHOLD = 0.7
#: Begins a piece of a word that isn't its beginning; white space, so no word has it.
LATER = "\x1f"
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def units(text: str) -> set[str]:
    """The distinct strings of a text that the kernel compares: lower-cased words without punctuation at their ends.

    Letters set apart by spaces are joined to one unit; a longer word gives overlapping pieces, of
    which all but the first begin with LATER.
    """
    low = text.lower().split()
    out = set(low)
    alone = [i for i, w in enumerate(low) if len(w) == 1]
    at = 0
    while at < len(alone):
        end = at
        while end + 1 < len(alone) and alone[end + 1] == alone[end] + 1:
            end += 1
        if end - at + 1 >= ORDER:
            out.add("".join(low[alone[at] : alone[end] + 1]))
        at = end + 1
    long = [w for w in out if len(w) > LONGEST]
    for w in long:
        out.discard(w)
        out.update((LATER if i else "") + w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2))
    return out


def unit(word: str) -> str:
    """A word as the kernel sees it: a mark for its beginning, no punctuation at its ends; empty if too short to compare."""
    v = word.strip(_EDGE)
    if v[:1] == LATER:
        v = v[1:].lstrip(_EDGE)
        return v if len(v) >= ORDER else ""
    return f"^{v}" if len(v) >= ORDER else ""


def candidates(words: Iterable[str]) -> set[str]:
    """Strings that can become landmarks: the units of a text and their beginnings of four to six letters."""
    own = {v for w in words if (v := unit(w))}
    return own | {v[:n] for v in own for n in (5, 6, 7) if len(v) > n}


def codes(words: list[str]) -> np.ndarray:
    return np.array(words, dtype=f"U{LONGEST + 1}").view(np.uint32).reshape(len(words), LONGEST + 1)


def kernel(left: np.ndarray, right: np.ndarray, paired: bool = False) -> np.ndarray:
    """Gap-weighted subsequence kernel of order 3 between code arrays: all of left with all of right, or row with row if paired.

    Every common subsequence of three characters counts DECAY to the power of the spans that it
    takes in both, so inserted characters and gaps weaken a match but keep it.
    """
    wide, high = int((left != 0).sum(axis=1).max(initial=0)), int((right != 0).sum(axis=1).max(initial=0))
    shape = (len(left),) if paired else (len(left), len(right))
    total, square = np.zeros(shape, np.float32), np.float32(DECAY * DECAY)
    decay = np.float32(DECAY)
    prime = [[np.float32(1)] * (high + 1), *([np.zeros(shape, np.float32) for _ in range(high + 1)] for _ in range(ORDER - 1))]
    for i in range(wide):
        c = left[:, i] if paired else left[:, i, None]
        same = [((c == right[:, j]) & (c != 0)).astype(np.float32) * square for j in range(high)]
        for j in range(high):
            total += same[j] * prime[ORDER - 1][j]
        for level in range(ORDER - 1, 0, -1):
            across = np.zeros(shape, np.float32)
            for j in range(high):
                # levels go down, so the lower one still holds the row before
                across *= decay
                across += same[j] * prime[level - 1][j]
                prime[level][j + 1] *= decay
                prime[level][j + 1] += across
            # entry 0 stays zero: no subsequence ends before the first character
    return total


def pair_bits(code: np.ndarray, reach: int) -> np.ndarray:
    """Bit sets, 256 bits in four longs, of the ordered letter pairs at most `reach` places apart in each row."""
    out = np.zeros((len(code), 4), np.uint64)
    for gap in range(1, reach + 1):
        for i in range(code.shape[1] - gap):
            rows = np.flatnonzero(code[:, i + gap])
            if not len(rows):
                break
            h = (code[rows, i] * np.uint32(0x9E3779B1) ^ code[rows, i + gap] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> np.uint32(24)
            out[rows, h >> np.uint32(6)] |= np.uint64(1) << (h & np.uint32(63)).astype(np.uint64)
    return out


def similarity(words: list[str], landmark: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark, a landmark's with itself counting as one; what exceeds one by much is no more alike.

    The kernel is a sparse one: it is nought for words that have, at most three places apart,
    under half of the letter pairs that are neighbours in the landmark. A word that holds the
    landmark with a letter put between any two has them all.
    """
    out = np.zeros((len(words), len(landmark)), np.float32)
    own_pairs = pair_bits(landmark, 1)
    need = (np.bitwise_count(own_pairs).sum(axis=1) + 1) // 2
    order = np.argsort([len(w) for w in words], kind="stable")
    for at in range(0, len(words), 8192):
        own = order[at : at + 8192]
        code = codes([words[i] for i in own])
        bits = pair_bits(code, 3)
        common = sum(np.bitwise_count(bits[:, k, None] & own_pairs[None, :, k]) for k in range(4))
        row, column = np.nonzero(common >= need)
        for i in range(0, len(row), 4096):
            r, c = row[i : i + 4096], column[i : i + 4096]
            out[own[r], c] = kernel(code[r], landmark[c], paired=True) / norm[c]
    return np.minimum(out, 1.25)


@dataclass
class Model:
    """Landmarks and a linear rule over their kernel map, with the margin's scale to a probability."""

    landmarks: list[str]
    whiten: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> np.ndarray:
        margin = _mapped(features, self.whiten) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))

    def scores(self, columns: Iterable[pa.Array]) -> Iterator[np.ndarray]:
        """For each array of texts, their scores, taken chunk by chunk: the features of a whole batch never stand together."""
        seen = Seen(self.landmarks)
        for column in columns:
            out = np.zeros(len(column))
            for part, x in seen.chunks(column):
                out[part] = self.score(x)
            del column
            yield out


def _mapped(features: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    """Nyström map of the greatest similarities, beside the amounts of near matches."""
    n = len(whiten)
    return np.hstack([features[:, :n] @ whiten, features[:, n:]])


class Seen:
    """Features of texts by landmark: the greatest similarity of any of a text's units, then the amount of near matches.

    Words met before in the task are looked up, in a table of at most `keep` words at a time; all
    words that are like no landmark share a line of it. Only a chunk's texts and features are held
    beside the table, whatever the size of the batches that they come in.
    """

    def __init__(self, landmarks: list[str], keep: int = 150_000) -> None:
        self.code = codes(landmarks) if landmarks else np.zeros((0, LONGEST + 1), np.uint32)
        self.norm = kernel(self.code, self.code, paired=True) if landmarks else np.zeros(0, np.float32)
        self.keep, self.place = keep, {}
        self.table, self.used = np.zeros((1, len(landmarks)), np.float32), 1

    def _learn(self, new: list[str]) -> None:
        by_unit: dict[str, list[str]] = {}
        for w in new:
            by_unit.setdefault(unit(w), []).append(w)
        self.place.update(dict.fromkeys(by_unit.pop("", []), 0))
        known = sorted(by_unit, key=len)
        for start in range(0, len(known), 8192):
            value = similarity(known[start : start + 8192], self.code, self.norm)
            some = np.flatnonzero(value.any(axis=1))
            if self.used + len(some) > len(self.table):
                # grown in place by an eighth, so that no second table stands beside it
                self.table.resize((self.used + len(some) + self.used // 8, self.table.shape[1]), refcheck=False)
            self.table[self.used : self.used + len(some)] = value[some]
            at = dict(zip(some.tolist(), range(self.used, self.used + len(some)), strict=True))
            for k, u in enumerate(known[start : start + 8192]):
                self.place.update(dict.fromkeys(by_unit[u], at.get(k, 0)))
            self.used += len(some)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of the texts of one chunk."""
        own_units = [units(t or "") for t in texts]
        new = list(set().union(*own_units) - self.place.keys())
        if len(self.place) + len(new) > self.keep:
            self.place, self.table, self.used, new = {}, np.zeros((1, self.table.shape[1]), np.float32), 1, list(set().union(*own_units))
        self._learn(new)
        out = np.zeros((len(texts), 2 * len(self.code)))
        for i, t in enumerate(own_units):
            near = [p for w in t if (p := self.place[w])]
            if near:
                own = self.table[near]
                out[i] = np.concatenate([own.max(axis=0), np.log1p(np.maximum(own - 0.75, 0).sum(axis=0) * 4)])
        return out

    def chunks(self, column: pa.Array) -> Iterator[tuple[slice, np.ndarray]]:
        for part in tx.row_slices(column, CHUNK):
            for start in range(part.start, part.stop, ROWS):
                own = slice(start, min(start + ROWS, part.stop))
                yield own, self.features(column[own].to_pylist())


def features(landmarks: list[str], columns: Iterable[pa.Array], keep: int = 150_000) -> Iterator[np.ndarray]:
    """The features (see Seen) of each array of texts."""
    seen = Seen(landmarks, keep)
    for column in columns:
        out = np.zeros((len(column), 2 * len(landmarks)))
        for part, x in seen.chunks(column):
            out[part] = x
        yield out


def _fit_linear(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Support vector machine with squared hinge by Newton steps, classes weighted to equal sums."""
    z = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    weight = cost * len(y) / 2 / np.where(y > 0, max(y.sum(), 1), max(len(y) - y.sum(), 1))
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    w, before = np.zeros(z.shape[1]), None
    for _ in range(rounds):
        active = sign * (z @ w) < 1
        if before is not None and (active == before).all():
            break
        part = z[active] * weight[active, None]
        w, before = np.linalg.solve(ridge + z[active].T @ part, part.T @ sign[active]), active
    return w[:-1], float(w[-1])


def _varied(words: list[str], most: int) -> list[str]:
    """The first words, leaving out those that are nearly the same as one taken before."""
    code = codes(words)
    alike = kernel(code, code)
    norm = np.sqrt(np.diag(alike))
    taken: list[int] = []
    for i in range(len(words)):
        if len(taken) < most and all(alike[i, j] < 0.75 * norm[i] * norm[j] for j in taken):
            taken.append(i)
    return [words[i] for i in taken]


def _fit_scale(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid: slope and shift of the margin by Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([margin, np.ones(len(margin))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (target - p) - 1e-6 * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, label) of at most max_labelled distinct labelled texts: those with the smallest hashes.

    docs and labels are joined on id_col. Only ids and hashes of texts, made in the scan, are
    shuffled to choose the sample; then its ids, of bounded number, are broadcast to fetch their
    texts, which are dealt to PARTS tasks. Copies of a text count once for each label. Rows with
    a null id, label or text are left out; repeated label rows count once.
    """
    seen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    own = own.select("id", F.xxhash64("text", F.lit("fit")).alias("h"), F.xxhash64(F.lit("more"), "text").alias("g"), "text")
    chosen = own.drop("text").join(seen, "id").groupBy("h", "g", "label").agg(F.min("id").alias("id")).orderBy("h", "g", "label").limit(max_labelled)
    # a row's id may repeat with other texts, so the hashes have to agree too
    found = own.join(F.broadcast(chosen), ["id", "h", "g"]).repartition(PARTS, "h", "g", "label")
    return found.groupBy("h", "g", "label").agg(F.min("text").alias("text")).select("text", "label")


def fit(texts: DataFrame, text_col: str = "text", label_col: str = "toxic", *, max_labelled: int = MAX_LABELLED, **options) -> Model:
    """fit_sample on at most max_labelled distinct rows of texts, those with the smallest hashes of their text."""
    own = texts.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label")).where("text is not null and label is not null")
    return fit_sample(own.distinct().orderBy(F.xxhash64("text", F.lit("fit")), "text", "label").limit(max_labelled).repartition(PARTS), **options)


def fit_sample(sample: DataFrame, *, tied: int = TIED, common: int = COMMON) -> Model:
    """Fit on labelled texts (text, label), all of them, of a bounded number.

    Landmarks are the words whose presence is most tied to label 1 among those rows, and words
    that many texts have; both lists are counted on Spark. Landmarks are units or their
    beginnings, so a stem can be one. A text is mapped to its greatest similarity with each
    landmark, whitened by the landmarks' own kernel matrix (Nyström), and a linear support vector
    machine is fitted on the driver, where the bounded sample's features come together. With one
    class only, the score is that class's share for all texts.
    """

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in tx.row_slices(batch.column(0), CHUNK):
                part = batch.slice(at.start, at.stop - at.start)
                rows = [(w, label) for t, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for w in candidates(units(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["w", "label"])

    sample = cut(sample)
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n == 0 or n1 in (0, n):
        share = (n1 + 1) / (n + 2)
        return Model([], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    count = sample.mapInArrow(words, "w string, label int").groupBy("w").agg(F.sum("label").alias("hit"), F.count("*").alias("n"))
    a, b, c, d = F.col("hit"), F.col("n") - F.col("hit"), F.lit(n1) - F.col("hit"), F.lit(n - n1) - (F.col("n") - F.col("hit"))
    chi = F.when(a * (n - n1) > b * n1, F.pow((a * d - b * c).cast("double"), 2) / ((a + b) * (c + d))).otherwise(0.0)
    ranked = count.withColumn("chi", chi)
    landmarks = _varied([r.w for r in ranked.where("chi > 0").orderBy(F.desc("chi"), F.desc(F.length("w")), "w").limit(12 * tied).collect()], tied)
    landmarks += [r.w for r in ranked.where(~F.col("w").isin(landmarks)).orderBy(F.desc("n"), "w").limit(common).collect()]

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[pa.Array] = []

        def column(it):
            for batch in it:
                labels.append(batch.column(1))
                yield batch.column(0)

        for x in features(landmarks, column(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(list(x.astype(np.float64)), pa.list_(pa.float64())), labels.pop(0)], ["x", "label"])

    # as Arrow, which the driver holds without an object for each number; in a fixed order, since the folds depend on it
    rows = sample.mapInArrow(mapped, "x array<double>, label int").toArrow().combine_chunks()
    y = rows["label"].to_numpy().astype(float)
    x = pa.concat_arrays(rows["x"].chunks).flatten().to_numpy().reshape(len(y), 2 * len(landmarks))
    order = np.lexsort((y, *x.T[::-1]))
    x, y = x[order], y[order]
    code = codes(landmarks)
    norm = kernel(code, code, paired=True).astype(np.float64)
    own_kernel = kernel(code, code).astype(np.float64) / np.sqrt(np.outer(norm, norm))
    value, vector = np.linalg.eigh((own_kernel + own_kernel.T) / 2)
    whiten = vector[:, value > 1e-2] / np.sqrt(value[value > 1e-2])
    z = _mapped(x, whiten)
    # margins for the scale come from rules that did not see the row
    fold, margin = np.arange(len(y)) * 7 % 3, np.zeros(len(y))
    for k in range(3):
        part = fold != k
        if 0 < y[part].sum() < part.sum():
            w, bias = _fit_linear(z[part], y[part])
            margin[~part] = z[~part] @ w + bias
    weight, bias = _fit_linear(z, y)
    slope, shift = _fit_scale(margin, y)
    return Model(landmarks, whiten, weight, bias, slope, shift)


def toxicity_score(model: Model, text: Column) -> Column:
    """Probability that a text is toxic; a null or empty text is scored as one without words."""

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in model.scores(columns):
            yield pa.array(x)

    return score(F.coalesce(text.cast("string"), F.lit("")))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least threshold; all columns stay. Scores where the rows lie, without a shuffle."""
    return docs.where(toxicity_score(model, F.col(text_col)) < threshold)
