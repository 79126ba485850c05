"""Texts and very many words: which words a text holds, and how a text without blanks falls apart into words."""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterable, Iterator, Mapping

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of one block, where a longer one counts once for every LONGEST characters: so a broadcast stays under some 60 MB.
#: A dictionary for segmentation takes words of up to LONGEST characters, a search words of any length.
BLOCK, LONGEST = 200_000, 64
#: Characters that the automaton of a search holds of a word.
HEAD = 16
#: Characters of texts whose words are held at once before they are passed on.
HELD = 1 << 18
#: What is segmented by the dictionary by default: Han characters. Of all else, runs of letters and digits are words.
HAN = "一-鿿"


def _held(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch's second column, a few at a time, with the number of the first; about HELD bytes, a longer text alone."""
    column = batch.column(1)
    size = pc.binary_length(column).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(size):
        if held + n > HELD and i > start:
            yield start, column.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n
    if start < len(column):
        yield start, column.slice(start).to_pylist()


class ManyWords:
    """Finds words of any length in texts: by an automaton over words of fewer than HEAD characters and the heads of all others, and a search among the sorted words of a head wherever it stands.

    Of the words that begin at one place each begins the next longer one. So only the longest is
    looked for behind a head: the last in order that the text is not ahead of, or else the nearest of
    those that it begins with. What the shorter ones have follows from it, once a text.
    """

    def __init__(self, words: Iterable[str]) -> None:
        self.machine = ahocorasick.Automaton()
        # up: the longest other word that one begins with; far: one further up, so that any is reached in a logarithm of steps
        self.up, self.far, depth, line = {"": ""}, {"": ""}, {"": 0}, [""]
        for head, group in itertools.groupby(sorted(words), lambda w: w[:HEAD]):
            if len(head) < HEAD:
                self.machine.add_word(head, head)
                continue
            own = list(group)
            self.machine.add_word(head, (own, max(map(len, own))))
            for word in own:
                while not word.startswith(line[-1]):
                    line.pop()
                up = line[-1]
                far = self.far[up]
                self.up[word], depth[word] = up, depth[up] + 1
                self.far[word] = self.far[far] if depth[up] - depth[far] == depth[far] - depth[self.far[far]] else up
                line.append(word)
        if len(self.machine):
            self.machine.make_automaton()

    def found(self, text: str) -> dict[str, list[int]]:
        """For each word that the text holds: how often and where first."""
        seen: dict[str, list[int]] = {}
        long: dict[str, list[int]] = {}
        for end, word in self.machine.iter(text) if len(self.machine) else ():
            if type(word) is str:
                if held := seen.get(word):
                    held[0] += 1
                else:
                    seen[word] = [1, end - len(word) + 1]
                continue
            own, most = word
            at = end + 1 - HEAD
            place = bisect.bisect_right(own, text[at : at + most])
            word = own[place - 1] if place else ""
            while not text.startswith(word, at):
                far = self.far[word]
                word = self.up[word] if text.startswith(far, at) else far
            if word:
                long.setdefault(word, [0, at])[0] += 1
        for word in list(long):
            while (word := self.up[word]) and word not in long:
                long[word] = [0, len(text)]
        for word in sorted(long, key=len, reverse=True):
            if up := self.up[word]:
                long[up] = [long[up][0] + long[word][0], min(long[up][1], long[word][1])]
        return seen | long


def matched(docs: DataFrame, words: DataFrame, id_col: str, text_col: str, word_col: str = "word") -> DataFrame:
    """(id, word, n, first_at): for each text and each distinct word that it holds, how often (overlaps count) and where first, from 0.

    Each task builds one automaton over all words (their trie with failure links; of long words,
    over their heads) and runs a text through it once, however many words there are. More than BLOCK
    words are dealt to blocks by a hash, of which each takes another pass over the texts. Words are
    taken as they are written, whatever their length; empty ones are left out, null texts hold none.
    """
    spark = docs.sparkSession
    own = words.select(F.col(word_col).cast("string").alias("word")).where(F.length("word") > 0).distinct()
    weight = own.agg(F.sum(F.ceil(F.length("word") / LONGEST))).first()[0] or 0
    blocks = max(1, math.ceil(weight / BLOCK * 1.1))
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for k in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(sorted(r.word for r in part.collect()))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = ManyWords(shared.value)

            def rows(batch: pa.RecordBatch, row: list[int], found: list[tuple[str, int, int]]) -> pa.RecordBatch:
                word, n, at = zip(*found, strict=True) if found else ((), (), ())
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(at, pa.int64())], ["id", "word", "n", "first_at"])

            for batch, (start, texts) in ((b, part) for b in batches for part in _held(b)):
                row, found, size = [], [], 0
                for i, text in enumerate(texts, start):
                    seen = finder.found(text or "")
                    row += [i] * len(seen)
                    found += [(w, n, at) for w, (n, at) in seen.items()]
                    # long words overlap, so a text can hold far more of them than its own characters
                    size += sum(map(len, seen))
                    if size > HELD:
                        yield rows(batch, row, found)
                        row, found, size = [], [], 0
                yield rows(batch, row, found)

        met = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, word string, n long, first_at long")
        out = met if out is None else out.union(met)
    return out


def answers(matches: DataFrame) -> DataFrame:
    """(id, hits, longest, first) of matched rows: how many words, the longest one (of equal ones the least), and the one that comes first (the longest of those)."""
    size = F.length("word")
    return matches.groupBy("id").agg(F.count("*").alias("hits"), F.min_by("word", F.struct(-size, F.col("word"))).alias("longest"), F.min_by("word", F.struct(F.col("first_at"), -size)).alias("first"))


class Segmenter:
    """Splits texts by the most probable path through the words of a dictionary (word: count)."""

    def __init__(self, counts: Mapping[str, int], characters: str = HAN) -> None:
        total = math.log(max(sum(counts.values()), 1))
        self.unknown = -total
        self.machine = ahocorasick.Automaton()
        for word, n in counts.items():
            if word and n > 0:
                self.machine.add_word(word, (len(word), math.log(n) - total))
        if len(self.machine):
            self.machine.make_automaton()
        self.pieces = re.compile(rf"[{characters}]+|[^\W_{characters}]+")
        self.own = re.compile(rf"[{characters}]")

    def cut(self, run: str) -> list[str]:
        """The words of a run of characters: of all ways to split it, the one whose words' chances multiply to most. A character without a word is one that was seen once; of equal ways, the one with the longer first word wins."""
        n = len(run)
        begin: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (size, weight) in self.machine.iter(run) if len(self.machine) else ():
            begin[end + 1 - size].append((end + 1, weight))
        score, after = [0.0] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            # words come by their ends, so the first is the shortest, and later ones win ties
            best, at = -math.inf, i
            if not begin[i] or begin[i][0][0] > i + 1:
                best, at = self.unknown + score[i + 1], i + 1
            for j, weight in begin[i]:
                if (s := weight + score[j]) >= best:
                    best, at = s, j
            score[i], after[i] = best, at
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(run[i:j])
            i = j
        return out

    def words(self, text: str) -> list[str]:
        out = []
        for m in self.pieces.finditer(text):
            out += self.cut(m[0]) if self.own.match(m[0]) else [m[0]]
        return out


def segmented(docs: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, *, characters: str = HAN, most: int = BLOCK) -> DataFrame:
    """(id, word, n): how often each word is in each text, split by the dictionary (word, n), of which the `most` frequent words are broadcast.

    Runs of `characters` (a class of a regular expression) are split by the most probable path,
    worked out from a run's end to its beginning; other runs of letters and digits are words as
    they are, and all else parts words. Null and empty texts have none.
    """
    own = dictionary.where(F.length("word").between(1, LONGEST) & (F.col("n") > 0)).groupBy("word").agg(F.sum("n").alias("n"))
    shared = docs.sparkSession.sparkContext.broadcast({r.word: r.n for r in own.orderBy(F.desc("n"), "word").limit(most).collect()})
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Segmenter(shared.value, characters)
        for batch, (start, texts) in ((b, part) for b in batches for part in _held(b)):
            row, word, count = [], [], []
            for i, text in enumerate(texts, start):
                seen: dict[str, int] = {}
                for w in cutter.words(text or ""):
                    seen[w] = seen.get(w, 0) + 1
                row += [i] * len(seen)
                word += seen
                count += seen.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(word, pa.string()), pa.array(count, pa.int64())], ["id", "word", "n"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, word string, n long")


def word_frequencies(words: DataFrame, stop_words: DataFrame | None = None, most: int = 20) -> DataFrame:
    """(word, n): the `most` frequent words of segmented rows that are no stop words; ties go by the word."""
    own = words.where(F.trim("word") != "")
    if stop_words is not None:
        own = own.join(stop_words.select("word"), "word", "left_anti")
    return own.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
