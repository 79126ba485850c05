"""Removing repeated passages by overlapping three-line windows, on built-in Spark functions alone."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.lineage import cut, fresh, stored

LINES = 3
#: A window is hot above this share of all repeats, so there are at most HOT hot ones to broadcast.
HOT = 1000
#: A line is cut after these marks where a space follows, and after wide marks anywhere.
MARKS, WIDE = ".!?,", "\u3002\uff01\uff1f\uff0c"
#: Least bytes of all lines of a window together if one of them is a part of a line.
LEAST = 60
#: Set between lines while they are cut; no text has this code point, which Unicode sets aside for such use.
CUT = "\ufdd0"


def _marked(text: Column) -> Column:
    """A text with CUT after each mark and before each newline.

    Lines are cut at marks that belong to the content, so that a passage is cut alike wherever
    it stands.
    """
    text = F.coalesce(text, F.lit(""))
    wide = text
    for m in WIDE:
        wide = F.replace(wide, F.lit(m), F.lit(m + CUT))
    # ASCII alone has no wide marks to look for
    out = F.when(F.octet_length(text) == F.length(text), text).otherwise(wide)
    for m in MARKS:
        out = F.replace(out, F.lit(f"{m} "), F.lit(f"{m} {CUT}"))
    # a mark at the end of a line leaves nothing behind it
    return F.replace(F.replace(out, F.lit("\n"), F.lit(f"{CUT}\n")), F.lit(CUT + CUT), F.lit(CUT))


def _number(marked: Column) -> Column:
    """How many lines, counting the parts of one as such; nothing is left behind a mark at the end."""
    cuts = (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(CUT), F.lit("")))) / len(CUT.encode())
    return cuts.cast("int") + 1 - F.endswith(marked, F.lit(CUT)).cast("int")


def line_windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(id, t, pos, a, b): the place and the two parts, of 64 and 32 bits, of the hash of each window of consecutive lines of docs (id, t, text).

    Lines are compared without white space at their ends, with tabs and returns as spaces. A
    window of blank lines only is none, nor is one with a part of a line in it and under LEAST
    bytes.
    """
    plain = _marked(F.col("text"))
    for c in "\t\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    # one row for each line, with all lines at hand, so that windows are worked out by generated code
    text = docs.select("id", "t", plain.alias("m")).select("id", "t", F.split("m", CUT, -1).alias("l"), F.endswith("m", F.lit(CUT)).cast("int").alias("none"))
    # there is always a line; without "outer", Spark marks and splits each text once more in a filter for those with any
    line = text.select("id", "t", "l", (F.size("l") - F.col("none")).alias("n"), F.posexplode_outer("l").alias("pos", "x")).where(F.col("pos") <= F.col("n") - lines)
    near = [F.col("x"), *(F.get("l", F.col("pos") + k) for k in range(1, lines + 1))]
    own = [F.trim(F.ltrim(x, F.lit("\n"))) for x in near[:lines]]
    # a line is whole if it and the next begin with a newline; the first of all needs none
    new = [F.startswith(x, F.lit("\n")) for x in near]
    whole = ((F.col("pos") == 0) | new[0]) & functools.reduce(lambda p, q: p & q, new[1:lines]) & ((F.col("pos") + lines == F.col("n")) | new[lines])
    length = functools.reduce(lambda p, q: p + q, (F.octet_length(x) for x in own))
    return line.where((length > 0) & (whole | (length >= LEAST))).select("id", "t", "pos", F.xxhash64(*own).alias("a"), F.hash(F.xxhash64(F.lit(7), *own)).alias("b"))


def _split(right: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The rows of right, one for each key with its number n out of total, as the at most HOT hot ones and the others."""
    return F.broadcast(right.where(F.col("n") * HOT > total).drop("n")), right.where(F.col("n") * HOT <= total).drop("n")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, lines: int = LINES) -> DataFrame:
    """(id, t, removed): for each document with repeats, the first lines of windows that occurred before.

    Windows are ordered by doc_id (null last), then by place; each but the first of its kind is
    a repeat. Windows are written once, as a table. Their 64-bit hashes are counted, ahead of the
    shuffle as well; then the windows whose hash is not the only one of its kind, and these
    alone, are told apart by all 96 bits. Hot windows are joined by broadcasts of at most HOT rows.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.col(text_col).alias("text"))
    window = stored(line_windows(own, lines))
    twice = cut(window.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"))
    total = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot, cold = _split(twice, total)
    # a window with a hot hash goes where its place's hash sends it, and keeps the hot one beside
    window = window.join(hot.withColumn("hot", F.col("a")), "a", "left").select(F.expr("case when hot is null then a else xxhash64(id, t, pos) end").alias("k"), "hot", "id", "t", "pos", "b")
    window = window.join(cold.select(F.col("a").alias("k"), F.lit(True).alias("cold")), "k", "left").where("hot is not null or cold")
    window = stored(window.select("id", "t", "pos", F.coalesce("hot", "k").alias("a"), "b"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "t", "pos")
    # rows that agree in id and text have each window more than once, in one place
    many = cut(window.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last"))
    later = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t")) & (F.col("pos") == F.col("first.pos")))
    hot, cold = _split(many, total)
    found = window.join(hot, ["a", "b"]).where(later).select("id", "t", "pos")
    found = found.union(window.join(hot, ["a", "b"], "left_anti").join(cold, ["a", "b"]).where(later).select("id", "t", "pos"))
    return found.groupBy("id", "t").agg(F.collect_set("pos").alias("removed"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, lines: int = LINES, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with the lines left out that a repeated window of `lines` lines covers; all columns and rows stay.

    A line goes if any window that occurred before, in an earlier document or above, covers it;
    overlapping windows merge. A line with marks in it (MARKS before a space, or WIDE)
    counts as several, one up to each mark, so a passage that repeats on one long line, or
    that begins and ends within lines, goes too, but for what stands at its ends short of a
    mark. A document that loses all its lines keeps an empty text. With counts, two columns of
    those names get the numbers of lines, so counted, and of lines removed.

    A passage without marks on fewer newline-separated lines than a window stays.

    A null text has one empty line and stays null. A text of fewer lines than a window has none.
    Rows that agree in doc_id and text are one document: they repeat nothing of each other, and
    get the same result. Rows with a null doc_id come last in order.
    """
    gone_id, gone_t, gone, marked = fresh(docs, "gone_id", "gone_t", "gone", "marked")
    found = repeated_windows(docs, id_col, text_col, lines=lines).select(F.col("id").alias(gone_id), F.col("t").alias(gone_t), F.col("removed").alias(gone))
    own = docs.join(found, docs[id_col].eqNullSafe(F.col(gone_id)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(gone_t)), "left").withColumn(marked, _marked(F.col(text_col)))
    covered = F.array_distinct(F.flatten(F.transform(gone, lambda p: F.sequence(p, p + (lines - 1)))))

    def bound(value: Column, use) -> Column:
        """use(value) with value worked out once, however often use has it."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def rest(a: Column) -> Column:
        """What is left of the lines a: a newline stands between two wherever one lay between them."""
        # each line's number of newlines before it is counted by those that begin with one
        kept = bound(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), covered), lambda k: F.transform(k, lambda i, j: F.struct(F.get(a, i).alias("x"), (i > F.get(k, j - 1) + 1).alias("apart"), F.slice(a, F.get(k, j - 1) + 2, i - F.get(k, j - 1) - 1).alias("between"))))
        return F.array_join(F.transform(kept, lambda x, j: F.when(j == 0, F.ltrim(x["x"], F.lit("\n"))).when(x["apart"] & ~F.startswith(x["x"], F.lit("\n")) & F.exists(x["between"], lambda y: F.startswith(y, F.lit("\n"))), F.concat(F.lit("\n"), x["x"])).otherwise(x["x"])), "")

    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(bound(F.filter(F.split(marked, CUT, -1), lambda x, i: (x != "") | (i == 0)), rest))
    out = [text.alias(c) if c == text_col else docs[c] for c in docs.columns]
    if counts:
        out += [_number(F.col(marked)).cast("long").alias(counts[0]), F.coalesce(F.size(covered), F.lit(0)).cast("long").alias(counts[1])]
    return own.select(*out)
